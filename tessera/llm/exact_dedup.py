"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition sorts its (digest, length, id) records into a run in
which equal digests are already one record. Runs then meet in rounds along a
hypercube: in round r a node exchanges with the nodes whose label differs in
digit r and receives the pieces of their runs whose digest has its own digit
there, merges these sorted pieces, and again keeps one record for each digest:
the best identifier, the count, and the whole SHA-256 as proof of equality.
After the last round a node's label is the leading digits of its digests, so
each digest is in one place. A group of copies, however large, arrives at each
level as one record from each peer, so no key grows hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import NULL_ID, Workspace, by_key, id_out, ints, raw, slices

#: What normalising deletes: the characters of [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"
RECORD = np.dtype([("d", ">u8", 4), ("n", "<i8"), ("id", "<i8"), ("c", "<i8")])
RUN = "key int, run binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2048):
        found = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in raw(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(found, pa.binary())], ["id", "n", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest): code points of the text and SHA-256 of the text without blanks."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_digests, "id long, n long, digest binary")


def _unique(r: np.ndarray) -> np.ndarray:
    """A sorted run with equal digests made one: the longest text's, then smallest, id stays; counts add up."""
    if len(r) < 2:
        return r
    first = np.ones(len(r), bool)
    first[1:] = (r["d"][1:] != r["d"][:-1]).any(axis=1)
    at = np.flatnonzero(first)
    out = r[at]
    out["c"] = np.add.reduceat(r["c"], at)
    return out


def sort_run(r: np.ndarray) -> np.ndarray:
    """Records as a run: sorted by digest, then longest text, then id, one for each digest."""
    r = r.astype(RECORD)
    d = r["d"].astype("<u8")
    return _unique(r[np.lexsort((r["id"], -r["n"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))])


def _merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two runs as one: every record finds its place by search in the other run, none is sorted again."""
    if not len(a) or not len(b):
        return a if len(a) else b
    x, y = (np.ascontiguousarray(r["d"].astype(">u8")).view("S32").ravel() for r in (a, b))
    at = np.searchsorted(x, y)  # where b's records come before equal ones of a
    same = x[np.minimum(at, len(x) - 1)] == y
    left = a[at[same]]
    n, i = b["n"][same], b["id"][same]
    at[same] += ~((n > left["n"]) | ((n == left["n"]) & (i < left["id"])))  # of equal digests the better one comes first
    out = np.empty(len(a) + len(b), RECORD)
    place = at + np.arange(len(b))
    mine = np.ones(len(out), bool)
    mine[place] = False
    out[place], out[mine] = b, a
    return _unique(out)


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of runs, in pairs, so that each record is moved once a level."""
    runs = [r.astype(RECORD) for r in runs] or [np.zeros(0, RECORD)]
    while len(runs) > 1:
        runs = [_merge_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _pieces(run: np.ndarray, label: int, rnd: int, radix: int, rounds: int) -> Iterator[tuple[int, bytes]]:
    """The parts of a run for the peers of ``label`` in round ``rnd``."""
    bits = radix.bit_length() - 1
    shift = np.uint64(64 - bits * (rnd + 1))
    digit = ((run["d"][:, 0].astype("<u8") >> shift) & np.uint64(radix - 1)).astype(int)
    place = radix ** (rounds - 1 - rnd)
    base = label - (label // place % radix) * place
    for x in np.unique(digit):
        yield base + int(x) * place, run[digit == x].tobytes()


def _emit(pieces) -> Iterator[pa.RecordBatch]:
    for key, blob in pieces:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([blob], pa.binary())], ["key", "run"])


def best_ids(found: DataFrame, radix: int = 4, rounds: int | None = None, run_rows: int = 500_000) -> DataFrame:
    """(digest, keep_id, group_size) of ``digests`` rows by the rounds above.

    ``rounds``: nodes number radix ** rounds; by default so many that a node
    ends with about ``run_rows`` records at most.
    """
    if rounds is None:
        nodes, rounds = max(16, found.count() // run_rows), 1
        while radix**rounds < nodes:
            rounds += 1
    nodes = radix**rounds

    def local_runs(batches):
        run, held = [], 0
        label = TaskContext.get().partitionId() % nodes

        def full():
            return _emit(_pieces(merge(run), label, 0, radix, rounds))

        for b in batches:
            r = np.zeros(b.num_rows, RECORD)
            r["d"] = np.frombuffer(b"".join(b.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            r["n"], r["id"], r["c"] = ints(b.column("n")), ints(b.column("id")), 1
            run.append(sort_run(r))
            held += len(r)
            if held >= run_rows:
                run[:] = [merge(run)]
                held = len(run[0])
                if held >= run_rows:
                    yield from full()
                    run, held = [], 0
        if run:
            yield from full()

    def exchange(rnd):
        def step(batches):
            for key, rows in by_key(batches):
                run = merge([np.frombuffer(x["run"], RECORD) for x in rows])
                yield from _emit(_pieces(run, key, rnd, radix, rounds))

        return step

    def ended(batches):
        for _, rows in by_key(batches):
            r = merge([np.frombuffer(x["run"], RECORD) for x in rows])
            d = pa.array([x.tobytes() for x in r["d"]], pa.binary())
            yield pa.RecordBatch.from_arrays([d, pa.array(r["id"]), pa.array(r["c"])], ["digest", "keep_id", "group_size"])

    runs = found.mapInArrow(local_runs, RUN)
    for rnd in range(1, rounds):
        runs = runs.repartitionById(nodes, F.col("key")).sortWithinPartitions("key").mapInArrow(exchange(rnd), RUN)
    return runs.repartitionById(nodes, F.col("key")).sortWithinPartitions("key").mapInArrow(ended, "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after deleting blanks; null counts as empty,
    and all empty texts are one group. Of equal texts the row with the most
    code points stays, then the smallest id; null ids come last. Rows repeated
    with one id count in group_size and share the fate of that id. Other
    columns are ignored; an empty table gives no rows. Groups that hold more
    than one row in ``heavy`` of all, of which there are less than ``heavy``,
    are told to the rows by broadcast, so no task gets such a group.
    """
    own = Workspace(docs.sparkSession)
    found = own.write(digests(docs, id_col, text_col), "digests")
    best = own.write(best_ids(found), "groups")
    most = max(1, found.count() // heavy)
    large = F.broadcast(best.where(F.col("group_size") > most))
    rest = found.join(large.select("digest"), "digest", "left_anti").join(best.where(F.col("group_size") <= most), "digest")
    return found.join(large, "digest").unionByName(rest).select(
        id_out(),
        id_out("keep_id", "keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; a row is known by its id and text.

    So rows that share an id, or have none, are judged by their texts; of
    equal texts the kept id's rows stay, repeated ones too. All columns are
    kept as they are; an empty table stays empty.
    """
    own = Workspace(docs.sparkSession)
    found = own.write(digests(docs, id_col, text_col), "digests")
    best = own.write(best_ids(found), "groups")
    own.drop(found)
    names, at = docs.columns, docs.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            mark = [hashlib.sha256((t or b"").translate(None, BLANKS)).digest() for t in raw(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mark, pa.binary())], [*names, "__mark"])

    best = best.select(id_out("keep_id", "__kept"), F.col("digest").alias("__digest"))
    marked = docs.mapInArrow(step, StructType([*docs.schema.fields, StructField("__mark", BinaryType())]))
    same = marked[id_col].cast("long").eqNullSafe(best["__kept"]) & (marked["__mark"] == best["__digest"])
    return marked.join(best, same, "left_semi").drop("__mark")
