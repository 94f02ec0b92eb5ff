"""Column profiles and key discovery.

One scan of a table gives every count, minimum and maximum. Exact distinct
counts come from a second aggregation over (column, value), one for each kind
of value (whole numbers, doubles, times, text), so numbers are shuffled as
numbers: values are made distinct before they are shuffled and again after, and
the shuffle is by column and value, so a wide table or a column of few values
is no hot spot.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.catalog import NUMERIC, OTHER, TEMPORAL, TEXT, Catalog, Key

PROFILE = "table_name string, column_name string, data_type string, family string, num_rows long, null_count long, min_num double, max_num double, min_text string, max_text string"


def _as_number(column, kind: str):
    """Temporal values as seconds, numbers as they are."""
    return F.unix_micros(column.cast("timestamp")) / 1e6 if kind == TEMPORAL else column.cast("double")


def _values(df: DataFrame, cols: list) -> list[DataFrame]:
    """(p, v) of every non-null cell, a frame for each kind of value: the column's position and the value."""
    kinds: dict[str, list] = {}
    for c in cols:
        if c.family == OTHER:
            continue
        kind = df.schema[c.name].dataType
        if isinstance(kind, T.IntegralType):
            kinds.setdefault("long", []).append(c)
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            kinds.setdefault("double", []).append(c)
        elif c.family == TEMPORAL:
            kinds.setdefault("timestamp", []).append(c)
        else:
            kinds.setdefault("string", []).append(c)
    return [df.select(F.inline(F.array(*[F.struct(F.lit(c.position).alias("p"), F.col(f"`{c.name}`").cast(k).alias("v")) for c in own]))).where("v is not null") for k, own in kinds.items()]


def profile_table(catalog: Catalog, table: str) -> DataFrame:
    """One row for each column of ``table``: rows, nulls, distinct values, extremes, ratios.

    Ratios of an empty table: null_ratio 0, uniqueness_ratio null. Columns
    that are no scalar (arrays, structs, binary) get row and null counts only.
    """
    df, cols = catalog.tables[table], catalog.columns(table)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.col(f"`{c.name}`")
        aggs.append(F.count(x).alias(f"c{c.position}"))
        if c.family in (NUMERIC, TEMPORAL):
            aggs += [f(_as_number(x, c.family)).alias(f"{k}{c.position}") for k, f in (("a", F.min), ("z", F.max))]
        elif c.family == TEXT:
            aggs += [F.min(x).alias(f"a{c.position}"), F.max(x).alias(f"z{c.position}")]
    rows = []
    for c in cols:
        number, text = c.family in (NUMERIC, TEMPORAL), c.family == TEXT
        rows.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(c.name).alias("column_name"), F.lit(c.type).alias("data_type"), F.lit(c.family).alias("family"),
            F.lit(c.position).alias("position"), F.col("n").alias("num_rows"), (F.col("n") - F.col(f"c{c.position}")).alias("null_count"),
            (F.col(f"a{c.position}") if number else F.lit(None).cast("double")).alias("min_num"), (F.col(f"z{c.position}") if number else F.lit(None).cast("double")).alias("max_num"),
            (F.col(f"a{c.position}") if text else F.lit(None).cast("string")).alias("min_text"), (F.col(f"z{c.position}") if text else F.lit(None).cast("string")).alias("max_text"),
        ))
    base = df.agg(*aggs).select(F.inline(F.array(*rows)))
    values = _values(df, cols)
    if not values:
        out = base.withColumn("distinct_count", F.lit(None).cast("long"))
    else:
        distinct = reduce(DataFrame.unionByName, [v.distinct().groupBy("p").agg(F.count(F.lit(1)).alias("d")) for v in values])
        known = F.when(F.col("family") != OTHER, F.coalesce("d", F.lit(0))).cast("long")
        out = base.join(F.broadcast(distinct), F.col("position") == F.col("p"), "left").withColumn("distinct_count", known)  # a row for each column
    return out.select(
        "table_name", "column_name", "data_type", "family", "num_rows", "null_count",
        F.when(F.col("num_rows") > 0, F.col("null_count") / F.col("num_rows")).otherwise(F.lit(0.0)).alias("null_ratio"),
        "distinct_count",
        F.when((F.col("num_rows") > 0) & F.col("distinct_count").isNotNull(), F.col("distinct_count") / F.col("num_rows")).alias("uniqueness_ratio"),
        "min_num", "max_num", "min_text", "max_text",
    )


def profile(catalog: Catalog) -> DataFrame:
    out = None
    for t in sorted(catalog.tables):
        p = profile_table(catalog, t)
        out = p if out is None else out.unionByName(p)
    return out


def single_keys(profiles: DataFrame) -> DataFrame:
    """Columns whose every row is distinct; certain if no null was seen."""
    return profiles.where((F.col("num_rows") > 0) & (F.col("uniqueness_ratio") == 1)).select("table_name", F.array("column_name").alias("columns"), (F.col("null_count") == 0).alias("certain"))


def composite_pairs(rows: list) -> list[tuple[str, str]]:
    """Pairs of one table's profile rows that may be keys.

    Left out by rule: columns that are unique already (the pair would not be
    minimal), that have nulls, or that do not compare, and pairs that have
    less than one combination for each row.
    """
    fit = [r["column_name"] for r in rows if r["family"] != OTHER and r["null_count"] == 0 and r["num_rows"] > 0 and r["uniqueness_ratio"] != 1]
    known = {r["column_name"]: r["distinct_count"] for r in rows}
    return [(a, b) for a, b in combinations(fit, 2) if known[a] * known[b] >= rows[0]["num_rows"]]


def composite_keys(catalog: Catalog, table: str, rows: list, sketched: int = 200, batch: int = 16) -> DataFrame:
    """Two-column keys: pairs of columns no two rows share. ``rows``: the table's collected profile.

    Every pair that can be a key is looked at, however many there are. First
    sketches estimate the distinct values of ``sketched`` pairs in one scan,
    which shuffles nothing but sketches; a pair goes if it stays 15 % below
    the row count, more than seven times the sketch's error. The others are
    probed, ``batch`` in one scan: rows are reduced to a 128-bit hash of each
    pair, made distinct before and after the shuffle.
    """
    spark, df = catalog.spark, catalog.tables[table]
    pairs, left = composite_pairs(rows), []
    n = rows[0]["num_rows"] if rows else 0
    for at in range(0, len(pairs), sketched):
        own = pairs[at : at + sketched]
        found = df.agg(*[F.approx_count_distinct(F.xxhash64(F.col(f"`{a}`"), F.col(f"`{b}`")), 0.02) for a, b in own]).collect()[0]
        left += [pair for pair, d in zip(own, found, strict=True) if d >= 0.85 * n]
    out = spark.createDataFrame([], "table_name string, columns array<string>, distinct_count long")
    for at in range(0, len(left), batch):
        own = left[at : at + batch]
        cell = F.array(*[F.struct(F.lit(i).alias("p"), F.xxhash64(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("h"), F.xxhash64(F.lit(7), F.col(f"`{b}`"), F.col(f"`{a}`")).alias("g")) for i, (a, b) in enumerate(own)])
        d = df.select(F.inline(cell)).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("distinct_count")).where(F.col("distinct_count") == n)
        names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in own])
        out = out.unionByName(d.select(F.lit(table).alias("table_name"), names[F.col("p")].alias("columns"), "distinct_count"))
    return out.select("table_name", "columns")


def key_union(catalog: Catalog, discovered: DataFrame, declared: list[Key]) -> DataFrame:
    """Discovered keys tagged with the declared constraint of the same columns, and declared ones that were not found."""
    rows = [(k.table, sorted(k.columns), "primary" if k.primary else "unique") for k in declared]
    named = catalog.spark.createDataFrame(rows, "t string, c array<string>, declared string")
    same = (F.col("table_name") == F.col("t")) & (F.array_sort("columns") == F.col("c"))
    found = discovered.join(F.broadcast(named), same, "full_outer")
    return found.select(
        F.coalesce("table_name", "t").alias("table_name"), F.coalesce(F.array_sort("columns"), "c").alias("columns"), "declared",
        F.when(F.col("table_name").isNull(), "declared").otherwise("discovered").alias("method"),
        F.coalesce("certain", F.col("declared") == "primary").alias("certain"),
    )
