"""Token ids in binary shards of patched frame-of-reference blocks.

A shard is one byte string (all numbers little-endian):

    header   4s magic "TPF1", u32 version, u64 ids, u64 documents, u64 ids
             before the shard in its part, u32 blocks, u64 bytes of payload,
             u64 exceptions
    docs     i64 id of each document, u32 ids of each document
    index    u64 first payload byte of each block, u32 minimum, u8 width,
             u64 first exception of each block
    payload  each block's BLOCK values less the minimum, the low ``width`` bits
             of each, packed in 64-bit words of four lanes
    excepts  u16 place in the block, u32 high bits, for values wider than that

The width is that of a percentile of the block's values, so a few large values
do not widen the rest. The index makes any range readable alone. Shards are
rows of a Parquet table, whose commit protocol makes a task that runs twice
harmless and which any store that Spark writes can hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, claim, id_out, id_text, ints, sized, slices, store
from .token_ids import encoder

BLOCK, LANES = 256, 4
PERCENTILE = 90
HEAD = struct.Struct("<4sIQQQIQQ")
SHARD = "part int, shard int, ids long, image binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2 ** width as rows of LANES * width words."""
    v = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, LANES, 64).transpose(2, 0, 1))
    out = np.zeros((width, *v.shape[1:]), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        out[word] |= v[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= v[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(values), LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(-1, LANES, width).transpose(2, 0, 1))
    out, mask = np.empty((64, *w.shape[1:]), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        x = w[word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | w[word + 1] << np.uint64(64 - bit)
        out[j] = x & mask
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(-1, BLOCK)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each number below 2 ** 53."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.uint8)


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray, before: int) -> bytes:
    """The image of one shard."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.int64)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(-1, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.int64)
    v = v - low[:, None]
    rank = BLOCK * PERCENTILE // 100
    width = _bits(np.partition(v, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.uint8)
    size = width.astype(np.int64) * LANES * 8
    start = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        packed = _pack(v[own] & ((1 << int(w)) - 1), int(w)).astype("<u8").view(np.uint8)
        payload[(start[own][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    high = v >> width[:, None].astype(np.int64)
    row, place = np.nonzero(high)
    first = np.searchsorted(row, np.arange(blocks))
    head = HEAD.pack(b"TPF1", 1, n, len(doc_ids), before, blocks, len(payload), len(row))
    parts = [doc_ids.astype("<i8"), doc_lengths.astype("<u4"), start.astype("<u8"), low.astype("<u4"), width, first.astype("<u8"), payload, place.astype("<u2"), high[row, place].astype("<u4")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads an image: documents, and ids of any range."""

    def __init__(self, image: bytes):
        magic, version, self.n, docs, self.before, blocks, size, excepts = HEAD.unpack_from(image)
        if magic != b"TPF1" or version != 1:
            raise ValueError("not a shard of this format")
        at = HEAD.size
        out = []
        for kind, count in (("<i8", docs), ("<u4", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u8", blocks), ("u1", size), ("<u2", excepts), ("<u4", excepts)):
            out.append(np.frombuffer(image, kind, count, at))
            at += out[-1].nbytes
        self.doc_ids, self.lengths, self.start, self.low, self.width, self.first, self.payload, self.place, self.high = out

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi, by unpacking the blocks that hold them and no other."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, "<u4")
        a, b = lo // BLOCK, -(-hi // BLOCK)
        v = np.zeros((b - a, BLOCK), np.int64)
        width = self.width[a:b]
        for w in np.unique(width[width > 0]):
            own = np.flatnonzero(width == w)
            at = self.start[a:b][own].astype(np.int64)[:, None] + np.arange(LANES * 8 * int(w))
            v[own] = _unpack(self.payload[at].view("<u8").astype(np.uint64), int(w)).astype(np.int64)
        ends = np.append(self.first, len(self.place)).astype(np.int64)
        e = slice(ends[a], ends[b])
        row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        v[row, self.place[e]] |= self.high[e].astype(np.int64) << width[row].astype(np.int64)
        v += self.low[a:b].astype(np.int64)[:, None]
        return v.ravel()[lo - a * BLOCK : hi - a * BLOCK].astype("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20) -> None:
    """Encode every text, add ``end_id``, and write shards to ``path`` in ascending id.

    Documents are dealt by ranges of (id, hash of the text), so part p holds
    no larger ids than part p + 1, and are sorted within; texts, not ids,
    cross the network. A document is never split, so a shard holds
    ``shard_ids`` ids or one document more. Null texts are empty (one id),
    null ids come last, rows with one id are ordered by the hash of their
    texts. Added tokens of the vocabulary in a text have their own ids.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        encode = encoder(vocabulary, end_id)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def full():
            ids, names, lengths = map(np.concatenate, zip(*held, strict=True))
            image = write_shard(ids, names, lengths, before)
            return len(ids), pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "shard", "ids", "image"])

        size = 0
        for b in sized(batches):
            ids, begin = encode(b.column("text"))
            names, low = ints(b.column("id")), 0
            while low < len(names):  # cut where a shard is full
                high = min(len(names), int(np.searchsorted(begin[1:], begin[low] + shard_ids - size)) + 1)
                held.append((ids[begin[low] : begin[high]], names[low:high], np.diff(begin[low : high + 1])))
                size, low = size + int(begin[high] - begin[low]), high
                if size >= shard_ids:
                    n, batch = full()
                    yield batch
                    shard, before, size, held = shard + 1, before + n, 0, []
        if held:
            yield full()[1]

    rows = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    store(rows.mapInArrow(step, SHARD), path, **{"parquet.compression": "uncompressed"})


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the shards of ``path``."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("ids").alias("n")).collect())  # a row for each task that wrote
    offset, sum_ = {}, 0
    for part, n in totals:
        offset[part] = sum_
        sum_ += n
    held = spark.sparkContext.broadcast(offset)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            s = Shard(b.column("image")[0].as_py())
            data, n = s.read().tobytes(), s.lengths.astype(np.int64)
            ends = np.cumsum(n)
            start = ends - n
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(start.tolist(), ends.tolist(), strict=True)]
            first = held.value[b.column("part")[0].as_py()] + s.before
            cols = [pa.array(s.doc_ids), pa.array(first + start), pa.array(n), pa.array(crc, pa.int64())]
            names = ["id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(start, s.n).astype(np.int32)), pa.array(np.frombuffer(data, "<u4").astype("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = shards.mapInArrow(step, "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return out.select(id_out(), *[c for c in out.columns if c != "id"])


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``write_tokens`` to the shared folder, then ``read_tokens`` of it."""
    path = Workspace(docs.sparkSession).path("tokens")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
