"""Near duplicates by weighted MinHash signatures made of hashed darts.

A document is the multiset of its five-word shingles. Darts are thrown at the
plane of (element weight, rank) of every shingle by hashing, so equal shingles
get equal darts in every document; those that fall inside a shingle's weight
and below a rank that depends on the total weight are kept, and for each
coordinate of the signature the earliest one stays. That takes about
K ln K darts for a document however long it is. Documents that agree on a band
of coordinates become candidates, and candidates are compared exactly.

Copies (same words) are one document from the start. A bucket links its
members to its least one only, so a bucket of n gives n - 1 candidates, not
n * n. Where the exact comparison leaves members of a bucket in different
classes, pairs that were not compared may still be links: such buckets are
looked at again with their texts, all members against those outside the
largest class, in blocks where a bucket is large; the comparisons are made in
place and only links leave. So no link that a band shows is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, by_key, claim, id_out, id_text, ints, mix, portions, raw, slices, text_mark
from .components import components

WORDS = 5
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Darts thrown at a document on the mean; each coordinate stays empty with probability exp(-DARTS / K).
DARTS = float(K * np.log(K) + 2 * K)
BASE = 1 / 32  # ranks are cut into [0, BASE) and then doubling ranges
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("q", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            cache[name] = np.cumprod(x, dtype=np.uint64)
    return cache["p"][:n], cache["q"][:n]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Hash and text number of every shingle of all texts, and a digest of each text's words (None if it has none).

    Words are runs of letters and digits, and of any character beyond ASCII,
    in lower case. A text of fewer than WORDS words is one shingle.
    """
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = b" " + b" ".join(data) + b" "
    t = np.frombuffer(joined, np.uint8)
    size = np.array([len(d) + 1 for d in data], np.int64)
    ends = np.cumsum(size) + 1
    word = _IS_WORD[t]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    p, q = _powers(len(t) + 1)
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * p[: len(t)], dtype=np.uint64, out=total[1:])
    w = mix((total[stop] - total[start]) * q[start])
    owner = np.searchsorted(ends, start, "right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    digests = [hashlib.blake2b(w[a : a + n].tobytes(), digest_size=16).digest() if n else None for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    h = w.copy()
    m = np.uint64(0xD6E8FEB86659FD93)
    long = count >= WORDS
    full = len(w) - WORDS + 1
    if full > 0:
        h = w[:full].copy()
        for i in range(1, WORDS):
            h = h * m + w[i : i + full]
        ok = owner[:full] == owner[WORDS - 1 :]
        h, who = mix(h[ok]), owner[:full][ok]
    else:
        h, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero(~long & (count > 0))
    if len(short):
        own = np.array([int.from_bytes(digests[i][:8], "little") for i in short], np.uint64)
        h, who = np.append(h, own), np.append(who, short)
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    return h, who, digests


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def _poisson(area: float, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """P(at most n darts), n = 0, 1, ..., in a region of this area."""
    if area not in cache:
        n = np.arange(1, int(area + 12 * np.sqrt(area) + 24))
        log = np.concatenate([[0.0], np.cumsum(np.log(area / n))]) - area
        cache[area] = np.cumsum(np.exp(log))
    return cache[area]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (docs, K) of unsigned 64-bit darts, and which documents have one.

    ``elements``: hashes, distinct within an owner; ``weights``: positive
    numbers; ``owner``: document of each, ascending. The probability that two
    documents agree in a coordinate is their weighted Jaccard similarity.
    """
    out = np.zeros((docs, K), np.uint64)
    total = np.bincount(owner, weights, docs)
    has = total > 0
    # a weight covers unit cells, the last one in part
    cells = np.ceil(weights).astype(np.int64)
    cell_of = np.repeat(np.arange(len(elements)), cells)
    nth = np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)
    unit = mix(elements[cell_of] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    room = np.minimum(1.0, weights[cell_of] - nth)
    who = owner[cell_of]
    reach, todo = np.where(has, DARTS / np.maximum(total, 1e-300), 0.0), has.copy()
    while todo.any():
        own = todo[who]
        u, d, r = unit[own], who[own], room[own]
        keys, ranks, darts = [], [], []
        low, high, level = 0.0, BASE, 0
        while True:
            on = reach[d] > low
            if not on.all():
                u, d, r = u[on], d[on], r[on]
            if not len(u):
                break
            cdf = _poisson(high - low)
            x = mix(u + np.uint64((level + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1))
            f = _unit(x)
            hit = np.flatnonzero(f > cdf[0])
            n = np.searchsorted(cdf, f[hit])
            at = np.repeat(hit, n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(x[at] + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
            rank = low + (high - low) * _unit(dart)
            more = mix(dart)
            ok = (rank < reach[d[at]]) & (_unit(more) < r[at])
            dart, rank, more, at = dart[ok], rank[ok], more[ok], at[ok]
            coordinate = (mix(more) % np.uint64(K)).astype(np.int64)
            keys.append(d[at] * K + coordinate)
            ranks.append(rank / reach[d[at]])
            darts.append(dart)
            low, high, level = high, high * 2, level + 1
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(key + np.minimum(rank, 1 - 1e-9), kind="stable")
        key, dart = key[order], dart[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        got = np.zeros(docs * K, bool)
        got[key[first]] = True
        out.reshape(-1)[key[first]] = dart[first]
        todo = todo & ~got.reshape(docs, K).all(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return out, has


def counted(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with counts, sorted by text and hash."""
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return h[at], who[at], np.diff(np.append(at, len(h)))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Texts of about a million characters at a time, with their rows."""
    for b in slices(batches, 256):
        texts = [t.decode("utf-8", "replace") for t in raw(b.column("text"))]
        for lo, hi in portions(texts):
            yield texts[lo:hi], b.slice(lo, hi - lo)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near")
    for texts, b in _few(batches):
        h, who, digests = shingles(texts)
        h, who, n = counted(h, who)
        sig, has = dart_signatures(h, n.astype(float), who, len(texts))
        band = np.zeros((len(texts), BANDS), np.uint64)
        for i in range(BANDS):
            x = np.full(len(texts), i + 1, np.uint64)
            for j in range(ROWS):
                x = mix(x ^ sig[:, i * ROWS + j])
            band[:, i] = x
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
        bands = pa.ListArray.from_arrays(offsets, pa.array(band.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(digests, pa.binary()), bands], ["id", "mark", "digest", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (hash, count) multisets sorted by hash."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][x], b[1][y]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, who, _ = shingles([text.decode("utf-8", "replace")])
    h, _, n = counted(h, who)
    return h, n


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    The side that many pairs share, b, is joined second, so rows come sorted
    by it and its shingles are made once.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            good = []
            ids = ints(batch.column("b")).tolist()
            for i, (x, y) in enumerate(zip(raw(batch.column("left")), raw(batch.column("right")), strict=True)):
                if ids[i] != last:
                    last, right = ids[i], _one(y)
                good.append(similarity(_one(x), right) >= least)
            own = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(ints(batch.column(c))[own], pa.int64()) for c in ("a", "b")], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(step, "a long, b long")


def _elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number and owner of every (shingle, how many times before), so that the weighted Jaccard of two texts is that of sets."""
    found = [[], [], []]
    at = 0
    for lo, hi in portions(texts):
        h, who, n = counted(*shingles([t.decode("utf-8", "replace") for t in texts[lo:hi]])[:2])
        for x, y in zip(found, (h, who + at, n), strict=True):
            x.append(y)
        at += hi - lo
    h, owner, n = map(np.concatenate, found)
    shingle = np.unique(h, return_inverse=True)[1].astype(np.int64)
    most = int(n.max(initial=1))
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    code = np.repeat(shingle, n) * most + nth
    if most > 1:
        code = np.unique(code, return_inverse=True)[1]
    return code.astype(np.int32), np.repeat(owner, n)


def _across(least: float):
    """Links of one bucket between different classes; pairs are compared here and only links leave.

    A pair is compared in the first bucket it shares only, known by the whole
    band hashes; one pass over the elements of all members compares a member
    with every other one. What is left out cannot be a link or is not needed: pairs
    whose numbers of shingles alone keep them below ``least``, and pairs that
    links already found connect.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "bucket"):
            node = np.array([r["node"] for r in rows], np.int64)
            label = np.array([r["label"] for r in rows], np.int64)
            side = np.array([r["side"] for r in rows])
            texts, band = [r["text"].encode("utf-8", "replace") for r in rows], rows[0]["band"]
            bands = np.array([r["bands"] for r in rows], np.int64)
            del rows
            known, size = np.unique(label, return_counts=True)
            if len(known) == 1:
                continue
            big = known[size.argmax()]
            element, owner = _elements(texts)
            del texts
            total = np.bincount(owner, minlength=len(node))
            first = np.cumsum(total) - total
            on = np.zeros(int(element.max(initial=-1)) + 1, bool)
            links = []
            for i in np.flatnonzero(label != big).tolist():  # pairs are met from a member outside the largest class
                meets = (label != label[i]) & ((label == big) | (node > node[i])) & ((side != side[i]) | (side < 0))
                meets &= np.minimum(total, total[i]) >= least * (1 - 1e-9) * np.maximum(total, total[i])
                near = np.flatnonzero(meets)
                near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
                if not len(near):
                    continue
                own = element[first[i] : first[i] + total[i]]
                on[own] = True
                both = np.add.reduceat(on[element], first, dtype=np.int64)
                on[own] = False
                for j in near[both[near] / (total[near] + total[i] - both[near]) >= least].tolist():
                    if label[i] == label[j]:
                        continue
                    links.append((int(node[i]), int(node[j])))
                    old, new = (label[j], big) if label[i] == big else (label[i], label[j])  # the largest class keeps its name
                    label[label == old] = new
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return step


def _groups(docs: DataFrame, least: float, id_col: str, text_col: str, block: int) -> DataFrame:
    """(id, mark, class, kept) for each row of ``docs``.

    A node is a text's words (digest), numbered once; ids only choose what
    stands for a class, so texts that share an id stay apart.
    """
    own = Workspace(docs.sparkSession)
    base = id_text(docs, id_col, text_col).withColumn("mark", text_mark("text"))
    signed = own.write(base.mapInArrow(_signed, "id long, mark binary, digest binary, bands array<long>"), "signatures")
    worded = signed.where(F.col("digest").isNotNull())
    reps = worded.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("first"))
    reps = own.write(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "first.id", "first.mark"), "representatives")
    firsts = signed.select("id", "mark", "bands").join(reps.select("node", "id", "mark"), ["id", "mark"])
    firsts = own.write(firsts.select("node", "bands").dropDuplicates(["node"]), "firsts")
    members = firsts.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    buckets = own.write(buckets, "buckets")
    inside = members.join(buckets, "bucket")
    pairs = own.write(inside.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")

    # one text for each node that is a candidate, however many rows repeat it
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps.select("node", "id", "mark"), "node")
    texts = own.write(base.join(needed, ["id", "mark"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = own.write(_verified(pairs, texts, least).distinct(), "verified")
    labels = components(links)

    label = F.coalesce("label", "node").alias("label")
    placed = inside.where("n > 2").select("node", "bucket", "n").join(labels, "node", "left").select("node", "bucket", "n", label)
    torn = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("n").alias("n")).where("x <> y").select("bucket", "n")
    torn = own.write(torn, "torn")
    again = members.join(torn, "bucket").join(texts, "node").join(labels, "node", "left").join(firsts.select("node", "bands"), "node")
    # a bucket beyond a block meets as pairs of blocks (i, j); i = j compares within a block
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    again = again.select("node", "bucket", "band", "text", label, "bands", parts.alias("parts"), mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = again.select(
        "node", "label", "bands", "band", "text",
        F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"),
        F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"),
    )
    more = again.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across(least), "a long, b long")
    more = own.write(more, "second-look")
    own.drop(firsts, buckets, pairs, texts, torn)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # of a class stands the least (id, digest)
    linked = labels.join(reps, "node")
    tops = linked.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("top"))
    of = reps.join(labels.join(tops, "label").select("node", "top"), "node", "left")
    of = of.select("digest", F.coalesce("top", F.struct("id", "digest")).alias("top"))
    out = signed.select("id", "mark", "digest").join(of, "digest", "left")
    kept = F.col("top").isNull() | ((F.col("id") == F.col("top.id")) & (F.col("digest") == F.col("top.digest")))
    return out.select("id", "mark", F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("class"), kept.alias("kept"))


def near_groups(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = 500) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (least id of its class), kept.

    Classes are the connected components of similarity ``least`` or more:
    weighted Jaccard over the multisets of five-word shingles, exact for every
    candidate; a pair at 0.8 is a candidate with probability above 0.99997.
    Null, empty and wordless texts are never near anything. Copies share a
    class. Texts are compared and judged each for itself, also where they
    share an id or have none; a class is kept by the row with the least id,
    null last, and of texts with that id by the least digest. Rows repeated
    with one id and the same words share their fate. Other columns are
    ignored.
    """
    return _groups(docs, least, id_col, text_col, block).select(id_out(), id_out("class", "class_id"), "kept")


def drop_near(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = 500) -> DataFrame:
    """``docs`` with one document of each class; a row is known by its id and text."""
    gone = _groups(docs, least, id_col, text_col, block).where(~F.col("kept")).select(id_out("id", "__gone"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__gone"]) & (text_mark(text_col) == gone["__mark"]), "left_anti")
