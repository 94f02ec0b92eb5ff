"""Best-fit packing planned over a histogram of lengths.

The plan looks at how many pieces have each length, not at pieces: lengths are
placed from long to short, each into the open sequences with the least room
that still fits, a whole run of equal sequences at a time. So it costs the
same for a thousand or a trillion pieces, and what reaches the driver is one
count for each length. A run of placements is (length, first rank, count,
first sequence, offset); a piece finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Workspace, claim, id_out, id_text, ints, sized
from .token_ids import encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece.

    ``counts``: pieces of each length from 1 to ``capacity``. Sequences are
    numbered from 0, offsets have no gaps.
    """
    rooms: list[int] = []  # sorted
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    placed, sequences = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            runs = open_runs[room]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + count)
            else:
                runs.append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
                take = min(left, count)
                put(room, first + take, count - take)
            else:
                room, first = capacity, sequences
                take = -(-left // (capacity // length))
                sequences += take
            placed.append((length, rank, take, first, capacity - room))
            put(room - length, first, take)
            rank, left = rank + take, left - take
    return placed


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece, with its task and its rank there among pieces of its length."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        encode = encoder(vocabulary, end_id)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in sized(batches):
            ids, begin = encode(b.column("text"))
            n = np.diff(begin)
            parts = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            stop = n[owner] - (parts[owner] - 1 - piece) * capacity  # the first piece takes what is left over
            start = np.maximum(stop - capacity, 0)
            length = stop - start
            order = np.argsort(length, kind="stable")
            which, first, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(owner), np.int64)
            rank[order] = np.arange(len(owner)) - np.repeat(first - seen[which], count)
            seen[which] += count
            data = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            low = begin[:-1][owner] + start
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(low.tolist(), (low + length).tolist(), strict=True)]
            cols = [ints(b.column("id"))[owner], piece, start, length, crc, np.full(len(owner), task), rank]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

    return id_text(docs, id_col, text_col).mapInArrow(step, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["id", "piece", "start", "length", "ids_crc32", "task", "local"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, added tokens of the vocabulary among them, and
    ``end_id``; a null text is empty and gives one piece of length 1. A
    document longer than ``capacity`` is cut so that all pieces but the first
    are full. Equal lengths take places in any order; repeated rows and rows
    without an id are packed each; other columns are ignored; an empty table
    gives no rows. Texts pass in batches of a few MB, a longer one alone. The
    pieces are written once to the shared folder, so ranks hold however often
    a task is run again.
    """
    spark = docs.sparkSession
    cut = Workspace(spark).write(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    held = spark.sparkContext.broadcast(table)  # its size depends on capacity, not on the number of pieces

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        low = np.searchsorted(t[:, 0], np.arange(capacity + 2))
        for b in batches:
            length, rank = ints(b.column("length")), ints(b.column("local")) + ints(b.column("before"))
            run = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                run[own] = low[x] + np.searchsorted(t[low[x] : low[x + 1], 1], rank[own], "right") - 1
            cols = [b.column(n) for n in NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t[run, 3] + rank - t[run, 1]), pa.array(t[run, 4])], [*NAMES[:5], "sequence_id", "offset"])

    out = cut.join(before, ["length", "task"]).select(*NAMES[:5], "local", "before")
    out = out.mapInArrow(seat, ", ".join(f"{n} long" for n in [*NAMES[:5], "sequence_id", "offset"]))
    return out.select(id_out(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
