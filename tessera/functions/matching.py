"""Comparing result sets with references, as DataFrames and cell by cell."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.facts import NUMBER

EPSILON = 1e-6
_NUMBER = re.compile(NUMBER)


def number(value) -> float | None:
    """A number, or text that is exactly one."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        return float(value) if _NUMBER.match(value) else None
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(x) else x


def cells_equal(a, b) -> bool:
    """NULL equals NULL, numbers within a relative 1e-6 (numeric text too), else as text."""
    if a is None or b is None:
        return a is None and b is None
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return x == y or abs(x - y) <= EPSILON * (max(abs(x), abs(y)) or 1.0)
    return x is None and y is None and str(a) == str(b)


def canonical_cells(df: DataFrame) -> list[Column]:
    """The columns of ``df``, each cell as a text that is equal for equal cells: 12 significant digits for numbers."""
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            num: Column = x.cast("double")
        elif isinstance(f.dataType, T.StringType):
            num = F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))
        else:
            num = F.lit(None).cast("double")
        text = F.when(num.isNotNull() & ~F.isnan(num), F.format_string("#%.11e", num + F.lit(0.0))).otherwise(F.concat(F.lit("$"), x.cast("string")))
        out.append(F.when(x.isNotNull(), text))
    return out


def canonical(df: DataFrame) -> DataFrame:
    """``canonical_cells`` by position; names of columns may repeat."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[c.alias(f"k{i}") for i, c in enumerate(canonical_cells(plain))])


def match_sets(gold: DataFrame, candidate: DataFrame) -> bool:
    """Whether both have the same set of rows, cells compared in canonical form; two empty results match."""
    if len(gold.columns) != len(candidate.columns):
        return gold.isEmpty() and candidate.isEmpty()
    a, b = canonical(gold), canonical(candidate)
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the place (place) of each row, from 0, in the order that its plan gives; no task sees more than its own rows.

    The rows before each partition are counted by one job, which brings a
    number for each partition to the driver. So the order has to be the same
    whenever the plan runs: ``df`` has to be sorted by all that tells rows apart.
    """
    own = df.withColumn("__mid", F.monotonically_increasing_id())
    per = own.groupBy(F.shiftright("__mid", 33).alias("pid")).agg(F.count(F.lit(1)).alias("n")).orderBy("pid").collect()
    before, offsets = 0, []
    for r in per:
        offsets.append((r["pid"], before))
        before += r["n"]
    first = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    place = F.element_at(first, F.shiftright("__mid", 33)) + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return own.select(place.alias("place"), *df.columns)


def match_ordered(gold: DataFrame, candidate: DataFrame, order: Sequence[str]) -> bool:
    """Whether row i of both is equal for every i. ``order``: the sort keys both results are ordered by.

    Rows that these keys leave tied are put in the order of their cells on
    both sides, as nothing says which comes first.
    """
    if len(gold.columns) != len(candidate.columns):
        return gold.isEmpty() and candidate.isEmpty()

    def placed(df: DataFrame) -> DataFrame:
        keys = [F.expr(o) if not o.endswith(" DESC") else F.expr(o[:-5]).desc() for o in order]
        cells = [F.coalesce(c, F.lit("")).alias(f"k{i}") for i, c in enumerate(canonical_cells(df))]
        return numbered(df.sort(*keys, *cells).select(*cells))

    a, b = placed(gold), placed(candidate)
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def match_in_place(gold: DataFrame, candidate: DataFrame) -> bool:
    """Whether row i of both is equal for every i, in the order in which the results come."""
    a, b = numbered(canonical(gold)), numbered(canonical(candidate))
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def match_strict(gold: DataFrame, candidate: DataFrame) -> bool:
    """Set equality without any coercion: equal types and values, NULL equal to NULL."""
    if [f.dataType for f in gold.schema] != [f.dataType for f in candidate.schema]:
        return gold.isEmpty() and candidate.isEmpty()
    names = [f"c{i}" for i in range(len(gold.columns))]
    a, b = gold.toDF(*names), candidate.toDF(*names)
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def soft_f1(gold: list[Sequence], candidate: list[Sequence]) -> float:
    """Partial credit: rows are made distinct and paired by place, cells by membership; both empty is 1."""

    def distinct(rows):
        return [list(r) for r in dict.fromkeys(tuple(r) for r in rows)]

    g, c = distinct(gold), distinct(candidate)
    if not g and not c:
        return 1.0
    tp = fp = fn = 0.0
    for i in range(max(len(g), len(c))):
        if i >= len(c):
            fn += 1
        elif i >= len(g):
            fp += 1
        else:
            width = max(1, len(g[i]))
            hit = sum(x in g[i] for x in c[i])
            tp += hit / width
            fp += sum(x not in g[i] for x in c[i]) / width
            fn += sum(x not in c[i] for x in g[i]) / width
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def soft_scores(gold: DataFrame, candidate: DataFrame, ordered: bool = False) -> DataFrame:
    """``soft_f1`` (one row, f1) of two results of any size, cells compared in canonical form.

    Rows are paired by place: in the order of the results if they are
    ``ordered``, by first appearance, else in the order of their cells.
    """

    def placed(df: DataFrame) -> DataFrame:
        c = canonical(df)
        cells = c.select(F.array(*[F.coalesce(F.col(x), F.lit("")) for x in c.columns]).alias("cells"))
        if not ordered:
            return numbered(cells.distinct().sort("cells"))
        first = numbered(cells).groupBy("cells").agg(F.min("place").alias("at"))
        return numbered(first.sort("at").select("cells"))

    both = placed(gold).withColumnRenamed("cells", "g").join(placed(candidate).withColumnRenamed("cells", "c"), "place", "full_outer")
    width = F.greatest(F.size("g"), F.lit(1))
    only = lambda a, b: F.size(F.filter(a, lambda x: ~F.array_contains(b, x)))
    hit = F.size("c") - only("c", F.col("g"))
    paired = F.col("g").isNotNull() & F.col("c").isNotNull()
    tp = F.sum(F.when(paired, hit / width).otherwise(0.0))
    fp = F.sum(F.when(paired, only("c", F.col("g")) / width).when(F.col("g").isNull(), 1.0).otherwise(0.0))
    fn = F.sum(F.when(paired, only("g", F.col("c")) / width).when(F.col("c").isNull(), 1.0).otherwise(0.0))
    sums = both.agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return sums.select(F.when(F.col("n") == 0, 1.0).when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def numeric_series(gold: DataFrame, candidate: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: correct, max_diff, of two (label, value) tables; a label on one side only is not correct."""
    a = gold.toDF("label", "x").select("label", F.col("x").cast("double").alias("x"), F.lit(1).alias("l"))
    b = candidate.toDF("label2", "y").select("label2", F.col("y").cast("double").alias("y"), F.lit(1).alias("r"))
    both = a.join(b, F.col("label").eqNullSafe(F.col("label2")), "full_outer")
    diff = F.abs(F.col("x") - F.col("y"))
    good = (F.col("l").isNotNull() & F.col("r").isNotNull()) & (F.col("x").eqNullSafe(F.col("y")) | (diff <= tolerance))
    return both.agg(F.coalesce(F.every(F.coalesce(good, F.lit(False))), F.lit(True)).alias("correct"), F.max(diff).alias("max_diff"))


def reward(column: Column) -> Column:
    """Steps of reward for gold time over candidate time."""
    return F.when(column == 0, 0.0).when(column >= 2, 1.25).when(column >= 1, 1.0).when(column >= 0.5, 0.75).when(column >= 0.25, 0.5).otherwise(0.25)


def summarize(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores of a run: rows with strict, loose (booleans), soft (double), numeric (nullable boolean), latency_ms, tokens, gold_ms, cand_ms."""
    timed = F.col("strict") & (F.col("gold_ms") > 0) & (F.col("cand_ms") > 0)
    r = F.when(timed, reward(F.col("gold_ms") / F.col("cand_ms"))).otherwise(0.0)
    n = F.count(F.lit(1))
    return records.groupBy(*by).agg(
        n.alias("n"), F.sum(F.col("strict").cast("int")).alias("strict"), F.sum(F.col("loose").cast("int")).alias("loose"),
        F.sum((F.col("strict") != F.col("loose")).cast("int")).alias("disagreements"), F.avg("soft").alias("soft_f1"),
        F.sum(F.col("numeric").cast("int")).alias("numeric_correct"), F.count("numeric").alias("numeric_total"),
        (F.sum(F.sqrt(r) * 100) / n).alias("r_ves"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"),
        (F.sum("tokens") / F.nullif(F.sum(F.col("strict").cast("int")), F.lit(0))).alias("tokens_per_correct"),
    )


_RELATION = re.compile(r"\b(?:from|join)\s+([a-z_]\w*)(?:\s+(?:as\s+)?(?!on\b|where\b|join\b|inner\b|left\b|right\b|full\b|cross\b|group\b|order\b|limit\b|having\b|union\b|using\b)([a-z_]\w*))?", re.I)
_FROM = re.compile(r"\bfrom\b.*?(?=\bwhere\b|\bgroup\b|\border\b|\bhaving\b|\blimit\b|\bunion\b|$)", re.I | re.S)
_EQUAL = re.compile(r"\b([a-z_]\w*)\.([a-z_]\w*)\s*=\s*([a-z_]\w*)\.([a-z_]\w*)\b", re.I)


def join_pairs(sql: str) -> set[tuple[str, str]]:
    """Pairs of table.column that the query sets equal, whatever the order or the aliases; no pair with itself."""
    text = re.sub(r"'(?:[^']|'')*'", "''", sql)
    names = {}
    listed = [x for part in _FROM.findall(text) for x in _RELATION.findall(part.replace(",", " join "))]
    for table, alias in [*_RELATION.findall(text), *listed]:
        names[(alias or table).lower()] = table.lower()
        names.setdefault(table.lower(), table.lower())
    out = set()
    for a, x, b, y in _EQUAL.findall(text):
        pair = sorted((f"{names.get(a.lower(), a.lower())}.{x.lower()}", f"{names.get(b.lower(), b.lower())}.{y.lower()}"))
        if pair[0] != pair[1]:
            out.add(tuple(pair))
    return out


def join_scores(candidate: set, gold: set) -> tuple[float, float, float]:
    """Precision, recall, F1 of join pairs; nothing against nothing is 1."""
    if not candidate and not gold:
        return 1.0, 1.0, 1.0
    hit = len(candidate & gold)
    p, r = hit / len(candidate) if candidate else 0.0, hit / len(gold) if gold else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def top_level_order(sql: str) -> bool:
    """Whether the outermost query is ordered: ORDER BY outside all brackets and strings."""
    depth, kept = 0, []
    for c in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*", " ", sql):
        depth += (c == "(") - (c == ")")
        kept.append(c if depth == 0 else " ")
    return bool(re.search(r"\border\s+by\b", "".join(kept), re.I))
