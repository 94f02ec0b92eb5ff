"""Running totals and standings, found by how a measure moves along a calendar.

All measures of a table share one window over one join, so a table is sorted
once however many measures it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.catalog import NUMERIC, TEMPORAL, Catalog

MONOTONIC, VON_NEUMANN, MOVES = 0.99, 0.1, 0.15
_SEASON, _ROUND = re.compile(r"season|year", re.I), re.compile(r"round|sequence|order|^lap$", re.I)


@dataclass(frozen=True)
class SequencePlan:
    """How the rows of a table follow each other: joined to a calendar, by entity and season, in its order."""

    table: str
    calendar: str
    shared: str
    entities: tuple[str, ...]
    season: str | None
    order: str


def is_calendar(catalog: Catalog, table: str) -> bool:
    cols = catalog.columns(table)
    return any(_SEASON.search(c.name) for c in cols) and any(_ROUND.search(c.name) or c.family == TEMPORAL for c in cols)


def sequence_plan(catalog: Catalog, table: str, links: list[tuple[str, str, str, str]]) -> SequencePlan | None:
    """The first column of ``table`` that a calendar table has by name, with the other trusted link columns as entities."""
    for c in catalog.columns(table):
        for other in sorted(catalog.tables):
            cols = catalog.columns(other)
            if other == table or not is_calendar(catalog, other) or c.name not in {x.name for x in cols}:
                continue
            order = next((x.name for x in cols if _ROUND.search(x.name)), None) or next((x.name for x in cols if x.family == TEMPORAL), None)
            entities = tuple(dict.fromkeys(column for source, column, _, _ in links if source == table and column != c.name))
            if order and entities:
                return SequencePlan(table, other, c.name, entities, next((x.name for x in cols if _SEASON.search(x.name)), None), order)
    return None


def measures(catalog: Catalog, plan: SequencePlan, unique: set[str]) -> list[str]:
    """Numeric columns that are neither key, entity nor unique."""
    skip = {plan.shared, *plan.entities} | unique
    return [c.name for c in catalog.columns(plan.table) if c.family == NUMERIC and c.name not in skip]


def _steps(catalog: Catalog, plan: SequencePlan, names: list[str]) -> DataFrame:
    """v and d (step from the row before) for each measure, one row for each row and measure."""
    cal = catalog.tables[plan.calendar].select(F.col(plan.shared).alias("__key"), F.col(plan.order).alias("__order"), (F.col(plan.season) if plan.season else F.lit(None)).alias("__season"))
    t = catalog.tables[plan.table].join(cal, F.col(plan.shared) == F.col("__key"))
    w = Window.partitionBy(*plan.entities, *(["__season"] if plan.season else [])).orderBy("__order")
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("v"), F.col(f"__d_{n}").alias("d")) for n in names])
    return t.withColumns({f"__d_{n}": F.col(n).cast("double") - F.lag(F.col(n).cast("double")).over(w) for n in names}).select(F.inline(cells))


def monotonic(catalog: Catalog, plan: SequencePlan, names: list[str], least: float = MONOTONIC) -> DataFrame:
    """measure, negative, total, ratio, is_cumulative. Measures without a step are left out."""
    s = _steps(catalog, plan, names).groupBy("measure").agg(F.count("d").alias("total"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("negative")).where("total > 0")
    ratio = (F.col("total") - F.col("negative")) / F.col("total")
    return s.select("measure", "negative", "total", ratio.alias("ratio"), (ratio >= least).alias("is_cumulative"))


def grain_is_unique(catalog: Catalog, plan: SequencePlan) -> DataFrame:
    """One row: total, keys, is_unique, whether (entities, event) names a row."""
    d = catalog.tables[plan.table].groupBy(*plan.entities, plan.shared).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("keys")).withColumn("is_unique", (F.col("total") == F.col("keys")) & (F.col("total") > 0))


def von_neumann(catalog: Catalog, plan: SequencePlan, names: list[str], most: float = VON_NEUMANN, moves: float = MOVES) -> DataFrame:
    """measure, ratio (variance of steps over variance of values), moved (share of steps that are not 0), is_snapshot."""
    s = _steps(catalog, plan, names).groupBy("measure").agg(F.var_samp("d").alias("var_d"), F.var_samp("v").alias("var_v"), F.count("d").alias("total"), F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).alias("m"))
    s = s.where((F.col("total") > 0) & (F.col("var_v") > 0))
    ratio, moved = F.col("var_d") / F.col("var_v"), F.col("m") / F.col("total")
    return s.select("measure", ratio.alias("ratio"), moved.alias("moved"), ((ratio <= most) & (moved >= moves)).alias("is_snapshot"))
