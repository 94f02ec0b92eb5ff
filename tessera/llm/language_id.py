"""Language of a text, and of its parts.

Words are scored by letter trigrams, one log likelihood for each learned
language. The script of a word first narrows the languages to those seen with
that script. Viterbi then labels the words of a text, with a penalty for every
change of language, so a passage in another language becomes a span of its own
while single borrowed words do not.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import claim, crc_bucket, id_out, id_text, raw, remembered, sized

#: First code point and name of each script range (fixed values, Unicode blocks); "" is no one script.
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"),
    (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""),
    (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]
_WORDS = re.compile(r"[^\W\d_]+")
AWAY = -40.0


def script(word: str) -> str:
    return "latin" if word.isascii() else SCRIPTS[bisect_right(_STARTS, max(map(ord, word))) - 1][1]


def letters(chunk: str) -> list[str]:
    chunk = chunk.lower()
    return [chunk] if chunk.isalpha() else [w for w in _WORDS.findall(chunk) if w.isalpha()]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(word))]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int] = field(default_factory=dict)  # trigram -> row of weights; row 0 is for unseen ones
    weights: np.ndarray | None = None
    by_script: dict[str, list[bool]] = field(default_factory=dict)


def fit(rows: list[tuple[str, str]], least: int = 2) -> Model:
    """Trigram log likelihoods from (text, lang) pairs."""
    counts: dict[str, Counter] = defaultdict(Counter)
    scripts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        for chunk, n in Counter(text.split()).items():
            for w in letters(chunk):
                scripts[lang][script(w)] += n * len(w)
                for g in trigrams(w):
                    counts[lang][g] += n
    langs = sorted(counts)
    all_grams = Counter()
    for c in counts.values():
        all_grams.update(c)
    kept = sorted(g for g, n in all_grams.items() if n >= least)
    weights = np.empty((len(kept) + 1, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        c = counts[lang]
        total = sum(c.values()) + 0.5 * (len(kept) + 1)
        weights[0, j] = math.log(0.5 / total)
        weights[1:, j] = np.log((np.fromiter((c[g] for g in kept), float, len(kept)) + 0.5) / total)
    used = {s for c in scripts.values() for s in c}
    by_script = {s: [scripts[x][s] >= 0.01 * sum(scripts[x].values()) for x in langs] for s in used if s}
    return Model(langs, {g: i + 1 for i, g in enumerate(kept)}, weights, {s: v for s, v in by_script.items() if any(v)})


class _Chunks(dict):
    """Chunk -> row of scores; new ones wait in ``pending``."""

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.pending.append(chunk)
        return at


class Labeller:
    """Scores and labels whole texts; keeps what it has scored, up to ``most`` chunks."""

    def __init__(self, model: Model, penalty: float = 8.0, most: int = 300_000):
        self.model, self.penalty, self.most = model, penalty, most
        self._reset()

    def _reset(self) -> None:
        self.seen = _Chunks()
        self.seen.pending = []
        self.scores = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.sizes = np.zeros((1 << 12, 2), np.int32)  # letters, and those of a learned script

    def _score_pending(self) -> None:
        m, new = self.model, self.seen.pending
        if not new:
            return
        end, at = len(self.seen), len(self.seen) - len(new)
        while len(self.scores) < end:
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        rows, bounds, get = [], [], m.grams.get
        away: dict[int, list[bool]] = {}
        for i, chunk in enumerate(new):
            bounds.append(len(rows))
            n = known = 0
            for w in letters(chunk):
                n += len(w)
                may = m.by_script.get(script(w))
                if may is None:
                    continue
                known += len(w)
                rows += [get(g, 0) for g in trigrams(w)]
                if not all(may):
                    away[i] = [a and b for a, b in zip(away.get(i, may), may, strict=True)]
            self.sizes[at + i] = n, known
        sums = np.zeros((len(new), len(m.langs)), np.float32)
        b = np.array(bounds)
        full = np.flatnonzero(np.diff(np.append(b, len(rows))))
        if len(full):
            sums[full] = np.add.reduceat(m.weights[np.array(rows)], b[full], axis=0)
        for i, may in away.items():
            sums[i, ~np.array(may)] += AWAY
        self.scores[at:end] = sums
        self.seen.pending.clear()

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text: the language number of each white-space separated word, and (letters, known letters) of each."""
        if len(self.seen) > self.most:
            self._reset()
        look = self.seen.__getitem__
        ids = [np.fromiter(map(look, cut), np.int32, len(cut)) for cut in (t.split() for t in texts)]
        self._score_pending()
        for labels, i in zip(self._viterbi(ids), ids, strict=True):
            yield labels, self.sizes[i]

    def _viterbi(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """All texts in step, longest first, so one array operation serves every text that is that long."""
        n = np.array([len(i) for i in ids], np.int64)
        order = np.argsort(-n, kind="stable")
        sizes = n[order]
        flat = np.concatenate([ids[o] for o in order]) if len(ids) else np.zeros(0, np.int32)
        start = np.cumsum(sizes) - sizes
        longest, states = int(sizes[0]) if len(sizes) else 0, len(self.model.langs)
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
        moved = np.zeros((len(flat), states), bool)
        best = np.zeros(len(flat), np.int16)
        label = np.zeros(len(flat), np.int16)
        value = np.zeros((len(sizes), states), np.float32)
        last = np.zeros(len(sizes), np.int16)
        for t in range(longest):
            k = active[t]
            at = start[:k] + t
            v = value[:k]
            if t:
                b = v.argmax(axis=1)
                jump = v[np.arange(k), b] - self.penalty
                worse = v < jump[:, None]
                moved[at], best[at] = worse, b
                np.maximum(v, jump[:, None], out=v)
            v += self.scores[flat[at]]
            v -= v.max(axis=1)[:, None]
        if longest:
            last[:] = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at = start[:k] + t
            s = last[:k]
            label[at] = s
            last[:k] = np.where(moved[at, s], best[at], s)
        out: list[np.ndarray] = [label] * len(ids)
        for j, o in enumerate(order):
            out[o] = label[start[j] : start[j] + sizes[j]]
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 750, folds: int = 5) -> Model:
    """Fit on about ``train_rows`` labelled rows of each language at most, spread by a hash of the identifier.

    So which languages are known does not depend on the size of the table.
    Rows of fold 0 are never read; rows without an id are in the fold of the
    empty identifier; null texts and null languages teach nothing.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_bucket(F.col(id_col), folds) != 0))
    every = {r[0]: max(1, r[1] // train_rows) for r in usable.groupBy(lang_col).count().collect()}  # a row for each language
    rate = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])[F.col(lang_col)] if every else F.lit(1)
    rows = usable.where(F.pmod(F.xxhash64(id_col), rate) == 0).select(text_col, lang_col).limit(2 * train_rows * max(1, len(every)))
    return fit(sorted((r[0], r[1]) for r in rows.collect()))


_labellers: dict[str, Labeller] = {}
remembered(_labellers.clear)


def _labeller(key: str, model: Model, penalty: float) -> Labeller:
    """The one of this worker, so that scored words outlive a task."""
    claim("language")
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(model, penalty)
    return _labellers[key]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, and with ``spans`` the spans (lang, first word, words) of each text.

    ``lang_pred`` has the most letters of the text in its spans; ``score`` is
    its share of all letters, letters of no learned script counting against
    it. A text that is null or has no letter is ``und`` with score 0, and so
    is every text if nothing was learned. Ties go to the first language by
    name. Rows are independent: nothing is shuffled, repeated rows give equal
    rows, rows without an id are labelled like others. Whole texts are read, a
    few MB at a time and a longer one alone. Other columns are ignored; an
    empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as the trigrams of the languages, not as the corpus
    key = uuid.uuid4().hex

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        labeller = _labeller(key, m, penalty)
        for b in sized(batches):
            texts = [t.decode("utf-8", "replace") for t in raw(b.column("text"))] if m.langs else [""] * b.num_rows
            lang, score, parts = [], [], []
            for label, size in labeller.label(texts):
                count = np.bincount(label, size[:, 1], len(m.langs)) if m.langs else np.zeros(1)
                total = int(size[:, 0].sum())
                top = int(count.argmax())
                lang.append(m.langs[top] if total else "und")
                score.append(float(count[top] / total) if total else 0.0)
                if spans:
                    cut = np.flatnonzero(np.diff(label)) + 1
                    ends = np.append(cut, len(label))
                    parts.append([{"lang": m.langs[label[a]], "first": int(a), "words": int(e - a)} for a, e in zip(np.append(0, cut), ends, strict=True) if e > a])
            data = [b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                data.append(pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(data, ["id", "lang_pred", "score"] + ["spans"] * spans)

    out = id_text(docs, id_col, text_col).mapInArrow(step, "id long, lang_pred string, score double" + (", spans array<struct<lang: string, first: int, words: int>>" if spans else ""))
    return out.select(id_out(), *out.columns[1:])


def keep_identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, penalty: float = 8.0) -> DataFrame:
    """``docs`` without texts that have no letter (null ones too), or whose main language has less than ``least`` of the letters that it could have.

    Letters of scripts that no learned language uses say nothing against a
    text, so a language that was not learned is no reason to drop it. The
    label is computed beside each row: whole rows pass once, with all their
    columns, and nothing is shuffled or joined. Repeated rows share their
    fate; an empty table stays empty.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def step(batches):
        m = held.value
        labeller = _labeller(key, m, penalty)
        for b in sized(batches, at):
            texts = [(t or b"").decode("utf-8", "replace") for t in raw(b.column(at))]
            if not m.langs:
                yield b.filter(pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_()))
                continue
            good = []
            for label, size in labeller.label(texts):
                count, known = np.bincount(label, size[:, 1], len(m.langs)), size[:, 1].sum()
                good.append(bool(size[:, 0].sum() and count.max() >= least * known))
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
