"""Exact top-k by inner product: a kNN join over Voronoi cells.

Largest inner product is least distance once every data vector has one more
component that lifts all of them to one norm. Data and queries are grouped by
the nearest of some pivots. A summary of each cell (range of distances to its
pivot, and the k least of them) bounds for every query how far its k-th
neighbour can be, and with the triangle inequality what range of distances
each cell has to deliver. Blocks of queries get just those rows of each cell,
score them by matrix products, and partial results are merged. The pivots
decide speed only; the answer is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, by_key, ints, mix, slices

ROWS = "key int, kind int, cell int, data binary"
SLACK = 1e-6
EMPTY = np.zeros(0)


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: float, dim: int | None = None) -> DataFrame:
    """id and integer vector of the rows that take part; filled up with zeros to ``dim``."""
    v = F.col(vector_col)
    good = df.where(v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)))  # a long; beyond its range the end of it
    if dim is not None:
        whole = F.when(F.size(v) == dim, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v))))
    return good.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return ints(batch.column("id")).astype(np.int64), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _distances(x: np.ndarray, extra: np.ndarray | float, pivots: np.ndarray) -> np.ndarray:
    """Distance of each lifted row to each pivot."""
    lifted = np.column_stack([x, np.broadcast_to(extra, len(x))]).astype(np.float64)
    d = (lifted**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, top - (x.astype(np.float64) ** 2).sum(axis=1)))


def _put(ids: np.ndarray, x: np.ndarray, kind: str) -> bytes:
    return np.array([len(ids), x.shape[1]], "<i8").tobytes() + ids.astype("<i8").tobytes() + x.astype(kind).tobytes()


def _get(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n, dim = np.frombuffer(data, "<i8", 2).tolist()
    return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, kind, n * dim, 16 + 8 * n).reshape(n, dim)


def _emit(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    k, t, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(t, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], ["key", "kind", "cell", "data"])


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, kind: type = np.int64):
        self.ids, self.k = ids, k
        self.q = np.zeros(0, np.int64)
        self.s = np.zeros(0, object if kind is object else np.int64)
        self.v = np.zeros(0, np.int64)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)

    def add(self, q: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        q, s, v = np.append(self.q, q), np.append(self.s, s), np.append(self.v, v)
        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -s[i], v[i])), np.int64) if s.dtype == object else np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.s, self.v = q[keep], s[keep], v[keep]
        full = rank == self.k - 1
        if s.dtype != object:
            self.least[q[full]] = s[full]

    def scores(self, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, kind: type) -> None:
        if kind is object:  # beyond 64 bits: exact numbers of Python, one by one
            exact = queries.astype(object) @ x.T.astype(object)
            for q in range(len(queries)):
                own = np.flatnonzero(ids != self.ids[q])
                self.add(np.full(len(own), q), exact[q, own], ids[own])
            return
        score = queries.astype(kind) @ x.T.astype(kind)
        score[self.ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        bar = self.least if kind is np.int64 else self.least.astype(kind)
        if score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        q, c = np.nonzero((score >= bar[:, None]) & (self.ids[:, None] != ids[None, :]))
        self.add(q, score[q, c].astype(np.int64), ids[c])


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, block: int = 2048, slice_rows: int = 2_000_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of ``data``, itself (by id) left out.

    Components become floor(scale * x), held within 64 bits. Ties go to the
    smaller id. A null vector or id, or one with a null or non-finite
    component, takes no part. Vectors shorter than the longest one count as
    filled up with zeros, an empty one as all zeros. Scores are exact; one
    beyond 64 bits is shown as the end of that range. Ids are taken to be
    unique; rows repeated with one id are candidates each, and a query each.
    Fewer rows than k give as many as there are; other columns are ignored.
    ``pivots`` (by default as many as the root of the rows, 32 to 512) bounds
    the sample and the summaries at the driver; query blocks number at most
    4096, whatever the input.
    """
    spark = data.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score long"

    def measured(df: DataFrame) -> tuple[int, int, float, float]:
        """Rows, longest vector, largest sum of squares, largest component."""
        v = F.transform("v", lambda x: x.cast("double"))
        got = _vectors(df, id_col, vector_col, scale).agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.max(F.array_max(F.transform(v, F.abs)))).collect()[0]
        return got[0], got[1] or 0, got[2] or 0.0, got[3] or 0.0

    count, dim, top, peak = measured(data)
    n_asked, dim_asked, _, peak_asked = measured(queries)
    dim = max(dim, dim_asked, 1)
    if not count or not n_asked:
        return spark.createDataFrame([], out_schema)
    points = _vectors(data, id_col, vector_col, scale, dim)
    asked = _vectors(queries, id_col, vector_col, scale, dim)
    bound = max(peak, 1) * max(peak_asked, 1) * dim * 1.001
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    most = max(peak, peak_asked)
    width = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    pivots = pivots or min(512, max(32, int(count**0.5)))
    every = max(1, count // pivots)
    sample = points.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(4 * pivots).collect() or points.limit(1).collect()
    sample = np.array([r["v"] for r in sorted(sample, key=lambda r: r["id"])][:pivots], np.int64)
    centres = np.column_stack([sample, _lift(sample, top)]).astype(np.float64)
    slack = max(SLACK, 2e-7 * dim**0.5) * (1 + top**0.5)  # more than distances may be off by rounding
    cells, kept = len(centres), k + 1  # one more, as a query may meet itself

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, low, high = [EMPTY] * cells, np.full(cells, np.inf), np.full(cells, -np.inf)
        for b in slices(batches, 8192):
            _, x = _matrix(b, dim)
            d = _distances(x, _lift(x, top), centres)
            cell = d.argmin(axis=1)
            d = d[np.arange(len(d)), cell]
            for j in np.unique(cell):
                own = d[cell == j]
                near[j] = np.sort(np.append(near[j], own))[:kept]
                low[j], high[j] = min(low[j], own.min()), max(high[j], own.max())
        rows = [(j, near[j].tolist(), float(low[j]), float(high[j])) for j in range(cells) if len(near[j])]
        yield pa.RecordBatch.from_pylist([{"cell": c, "near": n, "low": a, "high": z} for c, n, a, z in rows], pa.schema([("cell", pa.int32()), ("near", pa.list_(pa.float64())), ("low", pa.float64()), ("high", pa.float64())]))

    parts = points.mapInArrow(summarise, "cell int, near array<double>, low double, high double")
    parts = parts.select("cell", "low", "high", F.explode("near").alias("d"))
    ranked = parts.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.slice(F.sort_array(F.collect_list("d")), 1, kept).alias("near"))
    near = np.full((cells, kept), np.inf)
    low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
    for r in ranked.collect():  # one row for each pivot
        near[r["cell"], : len(r["near"])] = r["near"]
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for b in slices(batches, 8192):
            n += np.bincount(_distances(_matrix(b, dim)[1], 0.0, centres).argmin(axis=1), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(n)], ["cell", "n"])

    per_cell = dict(asked.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    base, split, blocks = _plan_blocks(centres, [per_cell.get(j, 0) for j in range(cells)], max(block, -(-n_asked // 4096)))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            ids, x = _matrix(b, dim)
            cell = _distances(x, 0.0, centres).argmin(axis=1)
            key = base[cell] + (mix(ids.view(np.uint64)) % split[cell]).astype(np.int64)
            yield _emit([(int(j), 0, 0, _put(ids[key == j], x[key == j], width)) for j in np.unique(key)])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.int32()), ("data", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
        for key, rows in by_key(batches):
            got = [_get(r["data"], width) for r in rows]
            ids, x = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            lo, hi = np.full(cells, np.inf), np.full(cells, -np.inf)
            for i in range(0, len(ids), 256):
                d = _distances(x[i : i + 256], 0.0, centres)
                reach = np.partition((d[:, :, None] + near[None]).reshape(len(d), -1), k, axis=1)[:, k, None]
                with np.errstate(invalid="ignore"):
                    lo, hi = np.minimum(lo, (d - reach).min(axis=0)), np.maximum(hi, (d + reach).max(axis=0))
            yield pa.RecordBatch.from_pylist([{"key": key, "data": _put(ids, x, width), "lo": (lo - slack).tolist(), "hi": (hi + slack).tolist()}], kinds)

    groups = asked.mapInArrow(deal_queries, ROWS).repartitionById(blocks, F.col("key")).sortWithinPartitions("key")
    groups = Workspace(spark).write(groups.mapInArrow(bounded, "key int, data binary, lo array<double>, hi array<double>"), "query-blocks")
    lo, hi = np.full((blocks, cells), np.inf), np.full((blocks, cells), -np.inf)
    for r in groups.select("key", "lo", "hi").collect():  # some thousand blocks at most
        lo[r["key"]], hi[r["key"]] = r["lo"], r["hi"]
    needed = spark.sparkContext.broadcast((lo, hi))
    parts_n = max(-(-count // slice_rows), -(-16 // blocks))  # slices of the data; they repeat queries, not rows

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            i, block_data = b.column("key")[0].as_py(), b.column("data")[0].as_py()
            for s in range(parts_n):
                yield _emit([(i * parts_n + s, 0, 0, block_data)])

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = needed.value
        for b in slices(batches, 8192):
            ids, x = _matrix(b, dim)
            d = _distances(x, _lift(x, top), centres)
            cell = d.argmin(axis=1)
            d = d[np.arange(len(d)), cell]
            part = (mix(ids.view(np.uint64)) % np.uint64(parts_n)).astype(np.int64)
            for i in range(len(lo)):
                use = np.flatnonzero((d >= lo[i, cell]) & (d <= hi[i, cell]))
                use = use[np.argsort(part[use], kind="stable")]
                for own in np.split(use, np.flatnonzero(np.diff(part[use])) + 1) if len(use) else []:
                    yield _emit([(i * parts_n + int(part[own[0]]), 1, 0, _put(ids[own], x[own], width))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, own = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                key, data = b.column("key")[r].as_py(), b.column("data")[r].as_py()
                ids, x = _get(data, width)
                if b.column("kind")[r].as_py() == 0:
                    if best is not None:
                        yield _partial(now // parts_n, best)
                    now, best, own = key, Best(ids, k, kind), x
                    continue
                for a in range(0, len(ids), 4096):
                    for c in range(0, len(own), 1024):
                        part = Best(best.ids[c : c + 1024], k, kind)
                        part.least = best.least[c : c + 1024].copy()
                        part.scores(own[c : c + 1024], ids[a : a + 4096], x[a : a + 4096], kind)
                        best.add(part.q + c, part.s, part.v)
        if best is not None:
            yield _partial(now // parts_n, best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            q, v, s = (np.concatenate(c) for c in zip(*(_whole(r["data"], kind) for r in rows), strict=True))
            best = Best(np.zeros(0, np.int64), k, kind)
            best.least = np.zeros(0 if kind is object else int(len(q)), np.int64)
            names, at = np.unique(q, return_inverse=True)
            best.add(at, s, v)
            rank = np.arange(len(best.q)) - np.searchsorted(best.q, best.q) + 1
            score = pa.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in best.s.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names[best.q]), pa.array(rank.astype(np.int32)), pa.array(best.v), score], ["query_id", "rank", "vec_id", "score"])

    n = blocks * parts_n
    sent = groups.select("key", "data").mapInArrow(send_queries, ROWS).unionByName(points.mapInArrow(send_data, ROWS))
    solved = sent.repartitionById(n, F.col("key")).sortWithinPartitions("key", "kind").mapInArrow(solve, ROWS)
    return solved.repartitionById(blocks, F.col("key")).sortWithinPartitions("key").mapInArrow(merge, out_schema)


def _plan_blocks(centres: np.ndarray, counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block of each cell, over how many blocks its queries are spread, and the number of blocks.

    Cells are taken along a chain of nearest pivots, so a block of about
    ``size`` queries is made of cells that are near each other; rows are sent
    once for each block that needs them, so blocks are few.
    """
    left, at, base, split = set(range(len(centres))), 0, np.zeros(len(centres), np.int64), np.ones(len(centres), np.uint64)
    blocks, fill = 0, size
    while left:
        n = counts[at]
        if n >= size:
            split[at] = -(-n // size)
            base[at], blocks, fill = blocks, blocks + int(split[at]), size
        elif n:
            if fill + n > size:
                blocks, fill = blocks + 1, 0
            base[at], fill = blocks - 1, fill + n
        left.discard(at)
        rest = np.array(sorted(left), np.int64)
        if len(rest):
            at = int(rest[((centres[rest] - centres[at]) ** 2).sum(axis=1).argmin()])
    return base, split, max(1, blocks)


def _partial(key: int, best: Best) -> pa.RecordBatch:
    """Query, candidate and score; exact scores beyond 64 bits as text."""
    rest = b"\n".join(b"%d" % x for x in best.s.tolist()) if best.s.dtype == object else best.s.astype("<i8").tobytes()
    return _emit([(key, 2, 0, np.concatenate([[len(best.q)], best.ids[best.q], best.v]).astype("<i8").tobytes() + rest)])


def _whole(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    q, v, rest = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n), data[8 + 16 * n :]
    return q, v, np.array([int(x) for x in rest.split()], object) if kind is object else np.frombuffer(rest, "<i8")
