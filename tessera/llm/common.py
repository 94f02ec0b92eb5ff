"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Stands for a null identifier inside an operator; such rows sort last.
NULL_ID = 2**63 - 1


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it by themselves."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_tessera", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_workers.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._tessera = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor reaches.

    A session on one machine (tests) that names none gets a temporary folder.
    On a cluster that is an error: executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tessera_folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext._tessera_folder = base
    return f"{base.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as Parquet; the shuffles of this one execution are deleted when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Workspace:
    """Tables that an operator writes to the shared folder: they cut the lineage and survive lost executors.

    ``drop`` deletes a table that nothing reads any more; what the operator's
    result reads has to stay. Within ``recorded`` such folders are noted, and
    ``finish`` deletes them, to be called once the results are written.
    """

    _noted: list[str] | None = None
    _left: dict[str, list[str]] = {}  # application -> folders noted

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    @classmethod
    @contextmanager
    def recorded(cls, spark: SparkSession) -> Iterator[None]:
        before, cls._noted = cls._noted, cls._left.setdefault(spark.sparkContext.applicationId, [])
        try:
            yield
        finally:
            cls._noted = before

    @classmethod
    def finish(cls, spark: SparkSession) -> None:
        left = cls._left.get(spark.sparkContext.applicationId, [])
        while left:
            delete(spark, left.pop())

    def path(self, tag: str) -> str:
        out = shared_path(self.spark, tag)
        if self._noted is not None:
            self._noted.append(out)
        return out

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        store(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t))[1]
            delete(self.spark, path)
            if self._noted is not None:
                self._noted.remove(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text): a null id becomes NULL_ID, a null text the empty text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def text_mark(text_col: str = "text"):
    """SHA-256 of a text's bytes, null as empty: with the id it names a row, whatever else has that id."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def id_out(name: str = "id", alias: str = "doc_id"):
    """The identifier column of a result, NULL_ID turned back to null."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(alias)


_forget: list[Callable[[], None]] = []
_owner: list[str] = []


def remembered(clear: Callable[[], None]) -> None:
    """Register what empties a module's memory in a worker."""
    _forget.append(clear)


def _lean() -> None:
    """Arrow and numpy give large arrays back when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library has its own way
        pass


def claim(name: str) -> None:
    """Called first by a task: what another operator kept in this worker goes, so stages in a row do not add up."""
    if not _owner:
        _lean()
    elif _owner[0] != name:
        for clear in _forget:
            clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library keeps its pages
            pass
    _owner[:] = [name]


def portions(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what an operator makes of them at once is bounded.

    Arrow's own batch is in memory already: its size is Spark's
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: str | int = "text", rows: int = 4096, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and about ``most`` bytes of ``column``, one row at least."""
    for b in slices(batches, rows):
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
            yield b.slice(at, end - at)
            at = end


def by_key(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[tuple[int, list[dict]]]:
    """Rows of key-sorted batches, gathered for one key at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if held:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if held:
        yield now, held


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_bucket(column, folds: int = 5):
    """crc32 of an identifier as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
