"""Quality scores from a sparse ensemble of rules.

A few text statistics are computed for each document. Small regression trees,
boosted on a bounded sample of labelled rows, propose rules: every path from
the root to a node is a conjunction of comparisons. A logistic model with an
L1 penalty over these rules keeps few of them. What is kept becomes one Spark
column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_bucket, id_out, id_text, raw, sized

STATS = ["chars", "words", "word_length", "distinct_words", "repeated_next", "upper_words", "symbols", "digits", "commas", "stops", "blanks", "lines", "distinct_lines", "ends_odd"]
_SYMBOLS = np.zeros(256, np.uint8)
for _kind, _set in enumerate((b"!#$%&*+<=>@[\\]^_`{|}~/", b"0123456789", b",;:", b".?", b" \t\r\x0b\x0c", b"\n"), 1):
    _SYMBOLS[list(_set)] = _kind
_SYMBOLS[0x80:0xC0] = 7  # continuation bytes: no characters of their own


def statistics(text: bytes) -> tuple[float, ...]:
    """The numbers named in STATS for one UTF-8 text; all 0 for an empty one."""
    n = np.bincount(_SYMBOLS[np.frombuffer(text, np.uint8)], minlength=8)
    s = text.decode("utf-8", "replace")
    w = s.split()
    chars, words = max(1, len(text) - int(n[7])), max(1, len(w))
    lines = [x for x in s.split("\n") if x]
    odd = sum(1 for x in lines if x[-1].isalnum())
    return (
        float(len(text) - int(n[7])), float(len(w)), (chars - n[5] - n[6]) / words, len(set(w)) / words,
        sum(map(eq, w, w[1:])) / words, sum(map(str.isupper, w)) / words, n[1] / chars, n[2] / chars, n[3] / words,
        n[4] / words, n[5] / chars, float(len(lines)), len(set(lines)) / max(1, len(lines)), odd / max(1, len(lines)),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of each row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            x = np.array([statistics(t) for t in raw(b.column("text"))], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x[:, j]) for j in range(len(STATS)))], ["id", *STATS])

    return id_text(docs, id_col, text_col).mapInArrow(step, "id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all to hold


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, between 0 and 1, over the columns of ``with_statistics``."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            cond = None
            for j, above, at in rule:
                part = F.col(STATS[j]) > F.lit(float(at)) if above else F.col(STATS[j]) <= F.lit(float(at))
                cond = part if cond is None else cond & part
            z = z + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[j]} {'>' if up else '<='} {at:.6g}" for j, up, at in r) for r, w in self.rules]


def _tree(bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """Grow by squared error over binned statistics; adds a path for each node and sets ``value`` in the leaves."""
    total, n = target[rows].sum(), len(rows)
    found = None
    if depth and n >= 2 * least:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            count = np.cumsum(np.bincount(bins[rows, j], minlength=len(e) + 1))[:-1]
            part = np.cumsum(np.bincount(bins[rows, j], target[rows], len(e) + 1))[:-1]
            ok = (count >= least) & (n - count >= least)
            if ok.any():
                with np.errstate(all="ignore"):
                    gain = np.where(ok, part**2 / count + (total - part) ** 2 / (n - count), -np.inf)
                k = int(gain.argmax())
                if found is None or gain[k] > found[0]:
                    found = gain[k], j, k
    if found is None or found[0] <= total**2 / n + 1e-9:
        value[rows] = total / max(1, n)
        return
    _, j, k = found
    low = bins[rows, j] <= k
    for above, own in ((False, rows[low]), (True, rows[~low])):
        p = tuple(sorted([*(c for c in path if c[:2] != (j, above)), (j, above, float(edges[j][k]))]))
        out.append(p)
        _tree(bins, edges, target, own, depth - 1, least, p, out, value)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in rule:
        out &= (x[:, j] > at) if above else (x[:, j] <= at)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, l1: float = 2e-3, seed: int = 7) -> Ensemble:
    """Rules from boosted trees, then proximal gradient steps for the L1 logistic weights."""
    if not len(y):
        return Ensemble(0.0, [])
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Ensemble(start, [])
    rng, z = np.random.default_rng(seed), np.full(len(y), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    paths: list[Rule] = []
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        value = np.zeros(len(y))
        _tree(bins, edges, y - 1 / (1 + np.exp(-z)), rows, depth, max(3, len(y) // 1000), (), new := [], value)
        paths += new
        z += 0.5 * value / max(1e-3, mean * (1 - mean))
        z = np.clip(z, -8, 8)
    kept, columns, known = [], [], set()
    for p in dict.fromkeys(paths):
        c = holds(p, x)
        if 0 < c.sum() < len(y) and (key := c.tobytes()) not in known:
            known.add(key)
            kept.append(p)
            columns.append(c)
    r = np.array(columns, np.float32).T.reshape(len(y), len(kept))
    w, b = np.zeros(len(kept), np.float32), start
    u, t, step = w.copy(), 1.0, 4.0 / max(1.0, float(np.linalg.norm(r, 2) ** 2 / len(y)))
    for _ in range(400):
        g = (1 / (1 + np.exp(-(r @ u + b))) - y) / len(y)
        new = u - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        b -= 2.0 * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = (new + (t - 1) / t2 * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), t2
    return Ensemble(b, [(p, float(v)) for p, v in zip(kept, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 12_000, folds: int = 5) -> Ensemble:
    """Fit on about ``train_rows`` labelled rows at most, spread by a hash; rows of fold 0 are never used, nor null ids or labels.

    Of several labels of one document the largest counts; a document that is
    repeated counts as often as it is there. Null texts have a label like any
    other. Without labels the model is a constant.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().where(crc_bucket(F.col("__id"), folds) != 0)
    usable = usable.groupBy("__id").agg(F.max("__y").alias("__y"))
    every = max(1, usable.count() // train_rows)
    chosen = usable.where(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).limit(2 * train_rows)
    own = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi")  # train_rows bounds the broadcast
    rows = with_statistics(own, id_col, text_col).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select(*STATS, "__y").collect()
    data = np.array([list(r) for r in rows], float).reshape(-1, len(STATS) + 1)
    data = data[np.lexsort(data.T)]  # the order of rows is not fixed
    return fit(data[:, :-1], data[:, -1])


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, empty and null texts too; nothing is shuffled.

    Rows are independent: repeated rows give equal rows, rows without an id
    are scored and are in the fold of the empty identifier. Whole texts are
    read, whatever their length. Other columns are ignored; an empty table
    gives no rows. Without any label the model is a constant: 0.5, or the
    share of label 1.
    """
    out = with_statistics(docs, id_col, text_col).select(id_out(), model.column().alias("score"))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
