"""Tables, their schema, and the constraints that Parquet files cannot carry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

NUMERIC, TEXT, TEMPORAL, BOOLEAN, OTHER = "numeric", "text", "temporal", "boolean", "other"


def family(kind: T.DataType) -> str:
    """The group of types whose values compare with each other."""
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return BOOLEAN if isinstance(kind, T.BooleanType) else OTHER


@dataclass(frozen=True)
class Key:
    table: str
    columns: tuple[str, ...]
    primary: bool = True
    name: str = ""


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    target: str
    target_column: str


@dataclass(frozen=True)
class ColumnInfo:
    table: str
    name: str
    position: int
    type: str
    family: str
    nullable: bool


@dataclass
class Catalog:
    """Lazily loaded tables by name, with declared keys and links; nothing is read before an action."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    keys: list[Key] = field(default_factory=list)
    links: list[ForeignKey] = field(default_factory=list)

    def columns(self, table: str) -> list[ColumnInfo]:
        return [ColumnInfo(table, f.name, i, f.dataType.simpleString(), family(f.dataType), f.nullable) for i, f in enumerate(self.tables[table].schema.fields)]

    def all_columns(self) -> list[ColumnInfo]:
        return [c for t in sorted(self.tables) for c in self.columns(t)]

    def only(self, names: Iterable[str]) -> Catalog:
        keep = set(names)
        return Catalog(self.spark, {t: d for t, d in self.tables.items() if t in keep}, [k for k in self.keys if k.table in keep], [x for x in self.links if {x.table, x.target} <= keep])

    def sample(self, table: str, order: list[str], rows: int = 5) -> DataFrame:
        """The first rows by ``order``, so the sample is the same every time."""
        return self.tables[table].orderBy(*order).limit(rows)

    def numeric_stats(self, table: str) -> DataFrame:
        """column_name, min, max, avg as doubles for each numeric column, in one pass."""
        names = [c.name for c in self.columns(table) if c.family == NUMERIC]
        d = self.tables[table].select([F.col(f"`{n}`").cast("double").alias(n) for n in names])
        one = d.agg(*[f(F.col(f"`{n}`")).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
        rows = F.array(*[F.struct(F.lit(n).alias("column_name"), *[F.col(f"{k}_{n}").alias(f"{k}_value") for k in ("min", "max", "avg")]) for n in names])
        return one.select(F.inline(rows))


#: Declared constraints of the analytics tables.
KEYS = [
    Key("region", ("r_regionkey",)), Key("nation", ("n_nationkey",)), Key("customer", ("c_custkey",)), Key("supplier", ("s_suppkey",)),
    Key("part", ("p_partkey",)), Key("orders", ("o_orderkey",)), Key("events", ("event_id",)),
]
LINKS = [
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def open_star(spark: SparkSession, folder: str, names: Iterable[str] = STAR) -> Catalog:
    """The star schema in ``folder``, one Parquet table for each name."""
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    return Catalog(spark, tables, list(KEYS), list(LINKS)).only(tables)


def run_sql(catalog: Catalog, text: str, parameters: list | dict | None = None) -> DataFrame:
    """A query over the catalog's tables, with ``?`` or ``:name`` parameters.

    The tables' names are visible to this query only: it is analysed at once,
    and views that had these names before are put back.
    """
    spark = catalog.spark
    before = {t: spark.table(t) for t in catalog.tables if spark.catalog.tableExists(t) and any(v.name == t and v.isTemporary for v in spark.catalog.listTables())}
    for t, d in catalog.tables.items():
        d.createOrReplaceTempView(t)
    try:
        return spark.sql(text, parameters) if parameters else spark.sql(text)
    finally:
        for t in catalog.tables:
            spark.catalog.dropTempView(t)
        for t, d in before.items():
            d.createOrReplaceTempView(t)


def with_timeout(spark: SparkSession, action: Callable[[], object], seconds: float) -> object:
    """Run an action under a job group that is cancelled after ``seconds``."""
    import threading
    import uuid

    group = f"timed-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "timed action", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
