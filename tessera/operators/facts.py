"""Facts about columns beyond the profile: numbers kept as text, value lists, stand-ins for null."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.catalog import NUMERIC, TEXT, Catalog

#: A finite number as text.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Values that stand for "unknown" (fixed values).
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "null", "none", "unknown", "?", "\\n"]


def numeric_text(catalog: Catalog, table: str, every_value: bool = True) -> DataFrame:
    """column_name and is_numeric_text of each text column; false for a column without values.

    ``every_value``: all values have to be numbers. Otherwise only the least
    and the greatest as text, which is cheaper and can be wrong.
    """
    names = [c.name for c in catalog.columns(table) if c.family == TEXT]
    if every_value:
        aggs = [F.coalesce(F.every(F.col(f"`{n}`").rlike(NUMBER)), F.lit(False)).alias(n) for n in names]
    else:
        aggs = [F.coalesce(F.min(f"`{n}`").rlike(NUMBER) & F.max(f"`{n}`").rlike(NUMBER), F.lit(False)).alias(n) for n in names]
    cells = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("is_numeric_text")) for n in names])
    return catalog.tables[table].agg(*aggs).select(F.inline(cells))


def value_dictionary(catalog: Catalog, table: str, columns: list[str], most: int = 50) -> DataFrame:
    """Distinct values, sorted by code point, of the columns that have ``most`` at most. One row for each value.

    No list is gathered: distinct (column, value) rows are counted by column
    and joined with the few columns that qualify.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    values = catalog.tables[table].select(F.inline(cells)).where("value is not null").distinct()
    few = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("column_name")
    return values.join(F.broadcast(few), "column_name").select(F.lit(table).alias("table_name"), "column_name", "value")


def null_placeholder(values: DataFrame) -> DataFrame:
    """The first listed value, by order, of each column that is a stand-in for null."""
    hit = F.lower(F.trim("value")).isin(PLACEHOLDERS)
    return values.where(hit).groupBy("table_name", "column_name").agg(F.min("value").alias("placeholder"))


def column_facts(profiles: DataFrame, keys: DataFrame, numeric: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Profile, keyness, numeric text and placeholder side by side; nullable is what was observed."""
    single = keys.where(F.size("columns") == 1).select("table_name", F.col("columns")[0].alias("column_name"), F.lit(True).alias("k")).distinct()
    out = profiles.join(F.broadcast(single), ["table_name", "column_name"], "left").join(F.broadcast(numeric), ["table_name", "column_name"], "left").join(F.broadcast(placeholders), ["table_name", "column_name"], "left")  # all are a row for each column
    return out.select(
        "table_name", "column_name", "data_type", "num_rows", "distinct_count", (F.col("null_count") > 0).alias("nullable"),
        F.coalesce("k", F.lit(False)).alias("is_unique"), F.coalesce("is_numeric_text", F.lit(False)).alias("is_numeric_text"), "placeholder",
    )


__all__ = ["NUMBER", "NUMERIC", "PLACEHOLDERS", "column_facts", "null_placeholder", "numeric_text", "value_dictionary"]
