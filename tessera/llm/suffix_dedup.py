"""Repeated byte strings across documents, by suffix arrays over routed contexts.

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id. All suffixes of a corpus in one array is no plan
for a cluster, so:

1. Anchors. Each window of ``width`` bytes has one anchor, its gram of
   ``GRAM`` bytes with the least hash; equal windows have equal anchors. Tasks
   send the distinct (anchor hash, text tag) pairs of their texts to parts by
   hash. An anchor met in one text only cannot be in a repeated window; the
   others are sent back to the groups of texts that asked. A group is named by
   the text's tag, and a task sends a text once, with the least id it has met.
2. Contexts. The group knows the least id of each text; every other row with
   that text goes as a whole. For the first one, each run of windows under one
   shared anchor is cut out with its bytes and sent to a bucket by anchor hash.
   Within a group equal contexts are sent once, for the smallest id; the
   others are known to repeat.
3. Suffix arrays. A bucket concatenates contexts and builds their suffix array
   by two-stage sorting: only suffixes smaller than their successor are
   sorted directly, the rest are induced by scanning buckets of the first byte
   in order. Order is needed to ``width`` bytes only. Common prefixes of
   neighbours of at least ``width`` bytes make classes; a window goes if its
   class has a smaller id.
4. Spans meet the rows, dealt by text and id, where they are joined and applied.

Texts cross the network twice, compressed; anchors take 14 bytes each. Every
step deals byte strings by hashes, and a passage met in thousands of texts is
reduced to one entry for each task before it is sent, so no key grows hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .common import NULL_ID, Workspace, by_key, claim, id_out, id_text, ints, mix, portions, raw, sized, slices

GRAM = 16
BLOB = "key int, kind int, data binary"
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


# ---------------------------------------------------------------- suffix array


def _word(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as numbers in the order of the bytes; ``t`` has 8 bytes to spare."""
    view = np.ndarray((len(t) - 7,), ">u8", t.data, strides=(1,))
    return view[at].astype(np.uint64)


def _sort_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` or more bytes that start there: by the first word, then ties by the next."""
    group = np.zeros(len(at), np.int64)
    lo = np.zeros(0, np.int64)
    rest = np.arange(len(at))
    at = at.copy()
    for d in range(0, depth, 8):
        if not len(rest):
            break
        key, own = _word(t, np.minimum(at[rest] + d, len(t) - 8)), group[rest]
        order = np.lexsort((key, own)) if d else np.argsort(key)
        at[rest], key, own = at[rest][order], key[order], own[order]
        new = np.ones(len(rest), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        lo = np.cumsum(new)
        group[rest] = lo
        tied = ~new
        tied[:-1] |= ~new[1:]
        rest = rest[tied]
    return at


def _next(mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first marked place from each place on, the last place if there is none."""
    return np.minimum.accumulate(np.where(mark, place, len(place) - 1)[::-1])[::-1]


def suffix_array(text: bytes, depth: int | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at least (all bytes: None), by two-stage sorting.

    ``wanted`` marks the suffixes that have to be there; some others may be
    too, as the scans pass through them. A suffix that is smaller than its
    successor is of type B and sorted directly; any other is of type A and
    induced from its successor, the last one from the empty end.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    t = np.zeros(n + 16, np.uint8)
    t[:n] = np.frombuffer(text, np.uint8)
    step = np.zeros(n, np.int8)  # 1: the next byte is larger, -1: smaller, 0: equal; the end is smaller than any byte
    step[:-1] = np.sign(t[1:n].astype(np.int16) - t[: n - 1])
    step[-1] = -1
    place = np.arange(n)
    b_type = step[_next(step != 0, place)] > 0
    if wanted is None:
        need = np.ones(n, bool)
    else:  # an A suffix needs its successors up to the first of type B
        w = np.flatnonzero(wanted)
        until = _next(b_type, place)[w]
        edge = -np.bincount(until + 1, minlength=n + 1)
        edge[w] += 1
        need = np.cumsum(edge)[:n] > 0
    direct = _sort_directly(t, np.flatnonzero(b_type & need), depth)
    if depth >= n and 0 in text:  # the sort took the end for zero bytes
        direct = np.array(sorted(direct.tolist(), key=lambda p: text[p:]), np.int64)
    first = t[direct]
    b_low = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[-1]:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(own: np.ndarray, byte: int) -> np.ndarray:
        """A suffixes just before ``own``; those that start with ``byte`` are returned, larger ones wait."""
        before = own[own > 0] - 1
        before = before[~b_type[before] & need[before]]
        c = t[before]
        same = c == byte
        later, c = before[~same], c[~same]
        if len(later):
            order = np.argsort(c, kind="stable")
            later, c = later[order], c[order]
            cut = np.flatnonzero(np.diff(c)) + 1
            for part, x in zip(np.split(later, cut), c[np.append(0, cut)], strict=True):
                waiting[x].append(part)
        return before[same]

    for byte in range(256):
        layer = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(layer):  # runs of one byte: each layer is scanned after the one it came from
            out.append(layer)
            layer = induce(layer, byte)
        own = direct[b_low[byte] : b_low[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, of the prefix that each suffix of ``order`` shares with the one before it."""
    n = len(text)
    t = np.zeros(n + limit + 16, np.uint8)
    t[:n] = np.frombuffer(text, np.uint8)
    out = np.zeros(len(order), np.int64)
    rest = np.arange(1, len(order))
    for d in range(0, limit, 8):
        if not len(rest):
            break
        x = _word(t, order[rest] + d) ^ _word(t, order[rest - 1] + d)
        same = x == 0
        y = x[~same]
        if len(y):
            high = np.frexp(y.astype(np.float64))[1]  # bit length, or one more after rounding up
            high -= (y >> np.minimum(high - 1, 63).astype(np.uint64)) == 0
            out[rest[~same]] = d + (64 - high) // 8
        rest = rest[same]
        out[rest] = d + 8
    out[1:] = np.minimum(out[1:], np.minimum(limit, n - np.maximum(order[1:], order[:-1])))
    return out


# ------------------------------------------------------------------- anchors


def _powers(n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get("p", ())) < n:
        p = np.full(max(n, 1 << 16), _POWER, np.uint64)
        p[0] = 1
        cache["p"] = np.cumprod(p, dtype=np.uint64)
    return cache["p"][:n]


def _gram_hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    h = mix(t.astype(np.uint64))
    size, m = 1, [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]
    k = 0
    while size < GRAM:
        h = h[:-size] * m[k] + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size, k = size * 2, k + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (w - size)], m[w - size :]) if w > size else m


def anchors(data: bytes, width: int) -> np.ndarray:
    """The anchor hash of the window at each place; empty below ``width`` bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    return _window_min(_gram_hashes(np.frombuffer(data, np.uint8)), width - GRAM + 1)


def _names(texts: list[bytes]) -> np.ndarray:
    """Two words that name each text: 128 bits of its SHA-256. The first one tells the group."""
    return np.frombuffer(b"".join([hashlib.sha256(t).digest()[:16] for t in texts]), "<u8").reshape(-1, 2)


# --------------------------------------------------------------------- blobs

ENTRY = np.dtype([("h", "<u8"), ("tag", "<u8")])
#: A removed run [a, b) of the text of a row; a == b only says that the row is the first one with its text.
SPAN = np.dtype([("key", "<u8"), ("more", "<u8"), ("id", "<i8"), ("a", "<i8"), ("b", "<i8")])
CONTEXT = np.dtype([("h", "<u8"), ("key", "<u8"), ("more", "<u8"), ("id", "<i8"), ("at", "<i8"), ("n", "<i8")])
OFTEN = np.dtype([("h", "<u8"), ("n", "<i8")])
SALTS = 16  # rows without an id are dealt to so many places
COUNTED = 64  # one context in so many is counted


def _squeeze(*parts: bytes) -> bytes:
    c = zstandard.ZstdCompressor(level=1)
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return len(parts).to_bytes(1, "little") + head + c.compress(b"".join(parts))


def _spread(blob: bytes) -> list[bytes]:
    k = blob[0]
    size = np.frombuffer(blob, "<i8", k, 1)
    data = zstandard.ZstdDecompressor().decompress(blob[1 + 8 * k :], max_output_size=int(size.sum()) or 1)
    out, at = [], 0
    for s in size.tolist():
        out.append(data[at : at + s])
        at += s
    return out


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, t, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(t, pa.int32()), pa.array(d, pa.binary())], ["key", "kind", "data"])


TEXT, SHARED, CTX, SPANS, LONE, COUNTS = range(6)


def _text_blobs(groups: int, width: int, most: int = 8 << 20):
    """Distinct texts of about ``most`` bytes at a time to their groups, each with the least id that has it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        held: dict[bytes, int] = {}
        size = 0

        def full():
            texts = list(held)
            group = (_names(texts)[:, 0] % np.uint64(groups)).astype(np.int64)
            rows = []
            for key, own in _split(group):
                some = [texts[i] for i in own.tolist()]
                rows.append((key, TEXT, _squeeze(np.array([len(x) for x in some], "<i8").tobytes(), np.array([held[x] for x in some], "<i8").tobytes(), b"".join(some))))
            return _rows(rows)

        for b in slices(batches, 1024):
            for doc, text in zip(ints(b.column("id")).tolist(), raw(b.column("text")), strict=True):
                if len(text) < width:  # neither repeats nor is repeated
                    continue
                if text not in held:
                    held[text] = doc
                    size += len(text)
                elif doc < held[text]:
                    held[text] = doc
                if size >= most:
                    yield full()
                    held.clear()
                    size = 0
        if held:
            yield full()

    return step


def _split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the places that have it, in order."""
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    for own in np.split(order, cut) if len(order) else []:
        yield int(group[own[0]]), own


def _place(key: np.ndarray, doc: np.ndarray, groups: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """Where a row is finished: by its text and id, so that copies of one text are apart; rows without an id by a salt, too."""
    doc = np.asarray(doc, np.int64)
    x = key ^ mix(np.where(doc == NULL_ID, salt, doc).astype(np.int64).view(np.uint64))
    return (mix(x) % np.uint64(groups)).astype(np.int64)


def _row_blobs(groups: int, most: int = 8 << 20):
    """Whole rows to the places where they are finished; columns after id and text are carried along."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        turn = 0
        for b in sized(batches, rows=1 << 16, most=most):
            texts, doc, rest = raw(b.column("text")), ints(b.column("id")).astype("<i8"), b.select(b.schema.names[2:])
            names, size = _names(texts), np.array([len(t) for t in texts], "<i8")
            rows = []
            for key, own in _split(_place(names[:, 0], doc, groups, (np.arange(len(doc)) + turn) % SALTS)):
                carried = rest.take(pa.array(own)).serialize().to_pybytes() if rest.num_columns else b""
                rows.append((key, TEXT, _squeeze(size[own].tobytes(), doc[own].tobytes(), names[own].tobytes(), carried, b"".join([texts[i] for i in own.tolist()]))))
            turn += len(doc)
            yield _rows(rows)

    return step


def _group(rows: list[dict]) -> dict[bytes, int]:
    """Distinct texts of a group with the least id of each."""
    texts: dict[bytes, int] = {}
    for r in rows:
        if r["kind"] != TEXT:
            continue
        sizes, ids, data = _spread(r["data"])
        at = 0
        for n, doc in zip(np.frombuffer(sizes, "<i8").tolist(), np.frombuffer(ids, "<i8").tolist(), strict=True):
            text = data[at : at + n]
            texts[text] = min(doc, texts.get(text, doc))
            at += n
    return texts


def _entries(width: int, parts: int, groups: int, most: int = 1 << 20):
    """Distinct (anchor, tag) pairs of a task's texts, to parts by hash.

    An anchor that one task meets in several texts is known to be shared: two
    of its pairs tell the part, and the groups of all its texts get it by way
    of some part, so a passage of very many texts is no long list anywhere.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        held, n = [], 0

        def full():
            e = np.concatenate(held)
            e = e[np.lexsort((e["tag"], e["h"]))]
            new = np.ones(len(e), bool)
            new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["tag"][1:] != e["tag"][:-1])
            e = e[new]
            first = np.ones(len(e), bool)
            first[1:] = e["h"][1:] != e["h"][:-1]
            last = np.append(first[1:], True)
            rows = []
            known = e[~(first & last)]
            for g, h in _dealt(known["tag"] % np.uint64(groups), known["h"] >> np.uint64(16), groups):
                rows.append((g % parts, SHARED, _squeeze(np.array([g], "<i8").tobytes(), h)))
            e = e[first | last]
            part = (e["h"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            e, part = e[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            return _rows(rows + [(p, LONE, _narrow(e[cut[p] : cut[p + 1]])) for p in range(parts) if cut[p] < cut[p + 1]])

        for b in slices(batches, 256):
            unique = [t for t in dict.fromkeys(raw(b.column("text"))) if len(t) >= width]
            for lo, hi in portions(unique):
                texts = unique[lo:hi]
                a = anchors(b"".join(texts), width)
                size = np.array([len(t) for t in texts])
                begin = np.repeat(np.cumsum(size) - size, size)[: len(a)]
                owner = np.repeat(np.arange(len(texts)), size)[: len(a)]
                pick = np.arange(len(a)) - begin <= size[owner] - width  # windows inside one text
                pick[1:] &= (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]) | ~pick[:-1]
                e = np.empty(int(pick.sum()), ENTRY)
                e["h"], e["tag"] = a[pick], _names(texts)[:, 0][owner[pick]]
                held.append(e)
                n += len(e)
            if n >= most:
                yield full()
                held, n = [], 0
        if held:
            yield full()

    return step


def _dealt(group: np.ndarray, h: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Distinct hashes of each group."""
    group = group.astype(np.int64)
    order = np.lexsort((h, group))
    group, h = group[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    group, h = group[new], h[new]
    cut = np.append(np.append(0, np.flatnonzero(np.diff(group)) + 1), len(group)) if len(group) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(group[a]), h[a:b].astype("<u8").tobytes()


def _narrow(e: np.ndarray) -> bytes:
    """Pairs in 14 bytes each: the upper 48 bits of the hash, and the tag."""
    h = (e["h"] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.concatenate([h, e["tag"].astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1).tobytes()


def _widen(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(-1, 14)
    e, w = np.empty(len(x), ENTRY), np.zeros((len(x), 8), np.uint8)
    w[:, :6] = x[:, :6]
    e["h"], e["tag"] = w.view("<u8")[:, 0], np.ascontiguousarray(x[:, 6:]).view("<u8")[:, 0]
    return e


def _shared(groups: int):
    """Anchors met in several texts, to the groups of those texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            out = []
            for r in rows:
                if r["kind"] == SHARED:
                    g, h = _spread(r["data"])
                    out.append((int(np.frombuffer(g, "<i8")[0]), SHARED, _squeeze(h)))
            lone = [_widen(r["data"]) for r in rows if r["kind"] == LONE]
            if lone:
                e = np.concatenate(lone)
                e = e[np.lexsort((e["tag"], e["h"]))]
                first = np.ones(len(e), bool)
                first[1:] = e["h"][1:] != e["h"][:-1]
                at = np.flatnonzero(first)
                size = np.diff(np.append(at, len(e)))
                keep = np.repeat(e["tag"][at] != e["tag"][at + size - 1], size)
                out += [(g, SHARED, _squeeze(h)) for g, h in _dealt(e["tag"][keep] % np.uint64(groups), e["h"][keep], groups)]
            if out:
                yield _rows(out)

    return step


def _contexts(width: int, buckets: int, most: int = 4 << 20):
    """Runs of windows under shared anchors, to buckets; what a group can tell alone stays as spans."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            lists = [np.frombuffer(_spread(r["data"])[0], "<u8") for r in rows if r["kind"] == SHARED]
            texts = sorted(_group(rows).items(), key=lambda x: x[1])
            del rows
            if not texts:
                continue
            names = _names([t for t, _ in texts])
            first = np.zeros(len(texts), SPAN)
            first["key"], first["more"], first["id"] = names[:, 0], names[:, 1], [i for _, i in texts]
            shared = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
            found: list[tuple[bytes, tuple]] = []
            least: dict[bytes, int] = {}  # the document that each context was met in first
            spans: list[tuple[int, int, int, int, int]] = []
            size = 0
            for (text, doc), name in zip(texts if len(shared) else [], names.tolist(), strict=False):
                a = anchors(text, width) >> np.uint64(16)
                at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                end = np.append(at[1:], len(a))
                h = a[at]
                hit = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
                for s, e, x in zip(at[hit].tolist(), end[hit].tolist(), h[hit].tolist(), strict=True):
                    own = text[s : e - 1 + width]
                    if least.setdefault(own, doc) == doc:
                        found.append((own, (x, *name, doc, s, e - s)))
                        size += len(own)
                    else:  # a smaller document of this group has it
                        spans.append((*name, doc, s, e - 1 + width))
                if size >= most:
                    yield _sent(found, buckets)
                    found, size = [], 0
                    least.clear()
            if found:
                yield _sent(found, buckets)
            yield from _home(_joined(np.concatenate([first, np.array(spans, SPAN)])), buckets)

    return step


def _sent(found: list[tuple[bytes, tuple]], buckets: int, counted: bool = True) -> pa.RecordBatch:
    by: dict[int, list[int]] = {}
    for i, (_, x) in enumerate(found):
        by.setdefault(x[0] % buckets, []).append(i)
    rows = [(k, CTX, _squeeze(np.array([found[i][1] for i in own], CONTEXT).tobytes(), b"".join([found[i][0] for i in own]))) for k, own in by.items()]
    if counted:  # by the name of a context, so an anchor is counted as well if each group has few of its contexts
        own = [x for _, x in found if (x[1] ^ x[4] * 0x9E3779B97F4A7C15) >> 32 & COUNTED - 1 == 0]
        h, n = np.unique(np.array([x[0] for x in own], np.uint64), return_counts=True)
        if len(h):
            often = np.empty(len(h), OFTEN)
            often["h"], often["n"] = h, n * COUNTED
            rows.append((0, COUNTS, _squeeze(often.tobytes())))
    return _rows(rows)


def _windows(c: np.ndarray, data: bytes, start: np.ndarray, width: int) -> tuple[list[tuple[bytes, tuple]], np.ndarray]:
    """The windows of contexts as contexts of their own, named by their bytes; of equal ones the least id's, and spans for the others."""
    least: dict[bytes, int] = {}
    pieces = list(zip(c.tolist(), start.tolist(), strict=True))
    for x, a in pieces:
        for i in range(a, a + x[5]):
            w = data[i : i + width]
            least[w] = min(least.get(w, x[3]), x[3])
    spans, one = [], []
    for x, a in pieces:
        for i in range(x[5]):
            w = data[a + i : a + i + width]
            if least[w] == x[3]:
                one.append((w, (int.from_bytes(hashlib.blake2b(w, digest_size=6).digest(), "little"), *x[1:4], x[4] + i, 1)))
            else:
                spans.append((*x[1:4], x[4] + i, x[4] + i + width))
    return one, _joined(np.array(spans, SPAN))


def _starts(c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each context in their joined bytes."""
    size = c["n"] + width - 1
    return np.cumsum(size) - size, size


def _scatter(width: int, buckets: int, hot: np.ndarray):
    """Contexts of anchors with very many of them, as single windows, to buckets by the window's hash."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            key, kind, blob = (b.column(c)[0].as_py() for c in ("key", "kind", "data"))
            c = np.zeros(0, CONTEXT)
            if kind == CTX:
                c, data = _spread(blob)
                c = np.frombuffer(c, CONTEXT)
            is_hot = np.isin(c["h"], hot)
            if not is_hot.any():
                yield _rows([(key, kind, blob)])
                continue
            start, size = _starts(c, width)
            rest = [(data[a : a + n], x) for x, a, n in zip(c[~is_hot].tolist(), start[~is_hot].tolist(), size[~is_hot].tolist(), strict=True)]
            one, spans = _windows(c[is_hot], data, start[is_hot], width)
            for part in (rest, one):
                if part:
                    yield _sent(part, buckets, counted=False)
            yield from _home(spans, buckets)

    return step


def _home(s: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Spans to where their rows are finished."""
    if not len(s):
        return
    lost = s["id"] == NULL_ID
    s = np.concatenate([s[~lost], np.repeat(s[lost], SALTS)])
    salt = np.concatenate([np.zeros(int((~lost).sum()), np.int64), np.tile(np.arange(SALTS), int(lost.sum()))])
    yield _rows([(g, SPANS, _squeeze(s[own].tobytes())) for g, own in _split(_place(s["key"], s["id"], groups, salt))])


def _joined(s: np.ndarray) -> np.ndarray:
    """Spans of each row with those that touch or overlap made one."""
    if not len(s):
        return s
    s = s[np.lexsort((s["a"], s["id"], s["more"], s["key"]))]
    other = (s["key"][1:] != s["key"][:-1]) | (s["more"][1:] != s["more"][:-1]) | (s["id"][1:] != s["id"][:-1])
    new = np.ones(len(s), bool)
    reach, low = np.empty(len(s), np.int64), 0
    for e in np.append(np.flatnonzero(other) + 1, len(s)).tolist():
        reach[low:e] = np.maximum.accumulate(s["b"][low:e])
        low = e
    new[1:] = other | (s["a"][1:] > reach[:-1])
    at = np.flatnonzero(new)
    out = s[at].copy()
    out["b"] = reach[np.append(at[1:], len(s)) - 1]
    return out


def repeated_windows(contexts: np.ndarray, data: bytes, width: int) -> np.ndarray:
    """Spans of windows that also start in a document with a smaller id, among these contexts."""
    size = contexts["n"].astype(np.int64) + width - 1
    start = np.cumsum(size) - size
    wanted = np.zeros(len(data), bool)
    n = contexts["n"].astype(np.int64)
    ctx = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    place = start[ctx] + inner
    wanted[place] = True
    owner = np.zeros(len(data), np.int32)
    owner[place] = ctx
    order = suffix_array(data, width, wanted)
    order = order[wanted[order]]
    new = common_prefixes(data, order, width) < width
    if len(new):
        new[0] = True
    ids = contexts["id"][owner[order]]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(ids, at) if len(at) else ids
    gone = ids > np.repeat(least, np.diff(np.append(at, len(ids))))
    p = order[gone]
    c = owner[p]
    out = np.empty(len(p), SPAN)
    for name in ("key", "more", "id"):
        out[name] = contexts[name][c]
    out["a"] = contexts["at"][c] + p - start[c]
    out["b"] = out["a"] + width
    return out


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("data").to_pylist():
            o = np.frombuffer(_spread(blob)[0], OFTEN)
            yield pa.RecordBatch.from_arrays([pa.array(o["h"].astype(np.int64)), pa.array(o["n"])], ["h", "n"])


def _twins(c: np.ndarray, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of contexts that are equal to one of a smaller id, and which contexts are left.

    A passage that many documents share is for the most part such contexts,
    so they need not be sorted; what is left are its edges and what differs.
    """
    seen: dict[bytes, int] = {}
    first = np.empty(len(c), np.int64)
    for i, a, n in zip((order := np.argsort(c["id"], kind="stable")).tolist(), start[order].tolist(), size[order].tolist(), strict=True):
        first[i] = seen.setdefault(data[a : a + n], i)
    twin = c["id"] > c["id"][first]
    out = np.empty(int(twin.sum()), SPAN)
    for name in ("key", "more", "id"):
        out[name] = c[name][twin]
    out["a"], out["b"] = c["at"][twin], c["at"][twin] + size[twin]
    return _joined(out), ~twin


def _solve(width: int, groups: int, hot: int, most: int = 1 << 20, hold: int = 64 << 20, last_round: bool = False):
    """The suffix arrays of a bucket, whole anchors at a time; spans go home.

    A bucket is read as a stream. Whenever ``hold`` bytes are at hand, anchors
    with ``hot`` contexts or more are cut into single windows that leave for
    another round, and so are their contexts from then on: an anchor of any
    size passes through bounded memory. In the last round, where a bucket has
    single windows only, equal ones are made one instead.
    """

    def thinned(c, data, hot_here, first):
        """What stays of contexts and bytes, and what leaves."""
        if last_round:
            one, spans = _windows(c, data, _starts(c, width)[0], width)
            return np.array([x for _, x in one], CONTEXT), b"".join([w for w, _ in one]), [], spans
        if first:
            h, n = np.unique(c["h"], return_counts=True)
            hot_here |= set(h[n >= hot].tolist())
        out = np.isin(c["h"], np.array(sorted(hot_here), np.uint64))
        start, size = _starts(c, width)
        one, spans = _windows(c[out], data, start[out], width)
        return c[~out], b"".join([data[a : a + s] for a, s in zip(start[~out].tolist(), size[~out].tolist(), strict=True)]), one, spans

    def solved(c, data):
        start, size = _starts(c, width)
        twins, left = _twins(c, data, start, size)
        if len(twins):
            c, start, size = c[left], start[left], size[left]
        order = np.argsort(c["h"], kind="stable")
        c, start, size = c[order], start[order], size[order]
        last = np.append(c["h"][1:] != c["h"][:-1], True)
        total, low, spans = np.cumsum(size), 0, []
        for e in (np.flatnonzero(last) + 1).tolist():
            if e < len(c) and total[e - 1] - (total[low - 1] if low else 0) < most:
                continue
            own = b"".join([data[a : a + s] for a, s in zip(start[low:e].tolist(), size[low:e].tolist(), strict=True)])
            spans.append(_joined(repeated_windows(c[low:e], own, width)))
            low = e
        return np.concatenate([twins, *spans])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, texts, size, limit, hot_here = None, [], [], 0, hold, set()

        def ended():
            c, data = np.concatenate(heads), b"".join(texts)
            if hot_here:
                c, data, one, spans = thinned(c, data, hot_here, False)
                yield _sent(one, groups, counted=False)
                yield from _home(spans, groups)
            yield from _home(solved(c, data), groups)

        for b in batches:
            for key, kind, blob in zip(b.column("key").to_pylist(), b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
                if key != now:
                    if heads:
                        yield from ended()
                    now, heads, texts, size, limit, hot_here = key, [], [], 0, hold, set()
                if kind == SPANS:  # found on the way, already addressed
                    yield _rows([(key, SPANS, blob)])
                    continue
                c, data = _spread(blob)
                heads.append(np.frombuffer(c, CONTEXT))
                texts.append(data)
                size += len(data)
                if size >= limit:
                    c, data, one, spans = thinned(np.concatenate(heads), b"".join(texts), hot_here, True)
                    yield _sent(one, groups, counted=False)
                    yield from _home(spans, groups)
                    heads, texts, size = [c], [data], len(data)
                    limit = max(hold, 2 * size)
        if heads:
            yield from ended()

    return step


def _apply(width: int, with_text: bool, carried: pa.Schema | None):
    """Each row with its spans joined and taken out; a row that is not the first with its text goes as a whole."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            found = [np.frombuffer(_spread(r["data"])[0], SPAN) for r in rows if r["kind"] == SPANS]
            s = _joined(np.concatenate(found)) if found else np.zeros(0, SPAN)
            own: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
            for key, more, doc, a, b in s.tolist():
                own.setdefault((key, more, doc), []).extend([(a, b)] if a < b else [])
            del found, s
            for r in rows:
                if r["kind"] != TEXT:
                    continue
                sizes, ids, names, rest, data = _spread(r["data"])
                at, out = 0, []
                for n, doc, name in zip(np.frombuffer(sizes, "<i8").tolist(), np.frombuffer(ids, "<i8").tolist(), np.frombuffer(names, "<u8").reshape(-1, 2).tolist(), strict=True):
                    text, cut = data[at : at + n], own.get((*name, doc))
                    at += n
                    if n < width:
                        cut = []
                    elif cut is None:
                        cut = [(0, n)]
                    edges = [0, *[x for run in cut for x in run], n]
                    out.append((doc, text, b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if cut else text, cut))
                if carried is not None:
                    left = pa.array([not cut or bool(kept.split()) for _, _, kept, cut in out])
                    some = pa.ipc.read_record_batch(pa.py_buffer(rest), carried).filter(left) if len(carried) else None
                    texts = pa.array([kept.decode("utf-8", "ignore") for _, _, kept, _ in out], pa.string()).filter(left)
                    yield pa.RecordBatch.from_arrays([texts, *(some.columns if some is not None else [])], ["text", *carried.names])
                    continue
                table = [(doc, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore"), [{"start": a, "end": b} for a, b in cut]] if with_text else [])) for doc, text, kept, cut in out]
                yield _table(table, with_text)

    return step


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _table(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.string(), _SPAN_LIST] * with_text
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _placed(base: DataFrame, width: int, group_bytes: int, hot_contexts: int, hold: int) -> DataFrame:
    """Blobs of the rows of ``base`` (id, text, carried columns) and of their spans, dealt and sorted by where they are finished."""
    if width < GRAM:
        raise ValueError(f"width has to be at least {GRAM}")
    own, texts_only = Workspace(base.sparkSession), base.select("id", "text")
    total = texts_only.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    groups = int(max(16, total // group_bytes))
    parts = max(16, groups // 4)

    def deal(df: DataFrame, n: int) -> DataFrame:
        return df.repartitionById(n, F.col("key")).sortWithinPartitions("key")

    texts = texts_only.mapInArrow(_text_blobs(groups, width), BLOB)
    shared = deal(texts_only.mapInArrow(_entries(width, parts, groups), BLOB), parts).mapInArrow(_shared(groups), BLOB)
    work = own.write(deal(texts.unionByName(shared), groups).mapInArrow(_contexts(width, groups), BLOB), "contexts")
    often = work.where(F.col("kind") == COUNTS).mapInArrow(_often, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(hot_contexts, total // 1_000_000)  # so the list has a million entries at most; less hot anchors leave their buckets later
    hot = np.array([r[0] for r in often.where(F.col("n") >= least).select("h").collect()], np.int64).astype(np.uint64)
    contexts = work.where(F.col("kind") != COUNTS)
    if len(hot):
        contexts = contexts.mapInArrow(_scatter(width, groups, hot), BLOB)
    spans = own.write(deal(contexts, groups).mapInArrow(_solve(width, groups, hot_contexts, hold=hold), BLOB), "spans")
    own.drop(work)
    again, spans = spans.where(F.col("kind") == CTX), spans.where(F.col("kind") == SPANS)
    if not again.isEmpty():
        spans = spans.unionByName(own.write(deal(again, groups).mapInArrow(_solve(width, groups, hot_contexts, hold=hold, last_round=True), BLOB), "spans-again"))
    return deal(base.mapInArrow(_row_blobs(groups), BLOB).unionByName(spans), groups)


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group_bytes: int = 4 << 20, hot_contexts: int = 20_000, hold: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``with_text`` also kept and spans.

    Texts are UTF-8 bytes, null is empty. ``kept`` drops characters that a
    removed span has cut apart. Rows repeated with one id count as one
    document, so they do not remove each other; null ids come last and count
    as one document. Other columns are ignored; an empty table gives no rows.
    ``group_bytes``: about so much text is in a group, and as much context in
    a bucket. ``hot_contexts``: an anchor with so many different contexts has
    its windows dealt singly, at the latest when its bucket holds ``hold``
    bytes; this changes where the work is done, not the result.
    """
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, spans array<struct<start: long, end: long>>" if with_text else "")
    out = _placed(id_text(docs, id_col, text_col), width, group_bytes, hot_contexts, hold).mapInArrow(_apply(width, with_text, None), schema)
    return out.select(id_out(), *out.columns[1:])


def brute_force(rows: list[tuple[int, bytes]], width: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for small inputs with distinct ids."""
    first: dict[bytes, int] = {}
    for doc, text in sorted(rows):
        for i in range(len(text) - width + 1):
            first.setdefault(text[i : i + width], doc)
    out = {}
    for doc, text in rows:
        gone = np.zeros(len(text) + 1, np.int64)
        for i in range(len(text) - width + 1):
            if first[text[i : i + width]] < doc:
                gone[i] += 1
                gone[i + width] -= 1
        mask = np.cumsum(gone)[: len(text)] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[doc] = (len(text), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def cut(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4 << 20, hot_contexts: int = 20_000, hold: int = 64 << 20) -> DataFrame:
    """``docs`` with repeats taken out of the texts; rows of which only blanks are left go, rows that had no more before stay.

    Every row is finished by itself, with its own text, and takes its other
    columns along, so rows may share an id or have none. A null text comes
    back empty; a text without repeats is as it was.
    """
    others = [c for c in docs.columns if c != text_col]
    plain = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)],
    )
    rest = plain.select(plain.columns[2:]).schema
    carried = to_arrow_schema(rest)
    out = _placed(plain, width, group_bytes, hot_contexts, hold).mapInArrow(_apply(width, True, carried), StructType([StructField("text", StringType()), *rest.fields]))
    return out.select(*[F.col("text" if c == text_col else f"__{others.index(c)}").alias(c) for c in docs.columns])
