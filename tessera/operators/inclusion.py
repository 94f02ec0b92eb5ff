"""Inclusion dependencies and the links scored from them.

All candidate pairs of one type family are checked by one job: distinct
values of every column involved are made once, and one join on the value
counts for each pair how many are met.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.catalog import OTHER, Catalog

MIN_CONTAINMENT = 0.7
RECOVER_SIMILARITY, RECOVER_SCORE = 1.0, 0.65
TRUSTED = 0.5


@dataclass(frozen=True)
class Pair:
    source: str
    column: str
    target: str
    target_column: str
    name_match: float = 0.0


@dataclass(frozen=True)
class Link:
    source: str
    column: str
    target: str
    target_column: str
    containment: float
    score: float
    kind: str = "foreign-key"  # self-reference, many-to-many
    cardinality: str = "one-to-many"
    evidence: str = "data"  # name, declared
    verified: bool = True
    junction: str = ""


def _singular(word: str) -> str:
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def name_similarity(column: str, table: str) -> float:
    """1 if the column is named after the table (``customer_id``, ``customerid``), 0.7 for part of its name, else 0."""
    table = table.lower()
    camel = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", column).lower()
    bases = {re.sub(r"_id$", "", camel).replace("_", ""), re.sub(r"id$", "", column.lower())} - {""}
    bases = {b for b in bases if b != column.lower()}
    flat, one = table.replace("_", ""), _singular(table.replace("_", ""))
    best = 0.0
    for b in bases:
        if b in (flat, one) or b + "s" == flat:
            return 1.0
        if b in flat and len(b) >= 0.7 * len(flat) or one in b:
            best = 0.7
    return best


def prefilter(profiles: list, keys: list[tuple[str, str]], self_references: bool = True) -> list[tuple[Pair, str]]:
    """Every (column, single-column key) pair with the reason it is dropped, or "" if it is kept.

    Reasons in order: same column; empty source; type family; and, unless the
    name matches, more distinct values than the target; range outside the
    target's. Unknown statistics never drop a pair. ``profiles``: collected
    rows of the profile, a few for each table.
    """
    by = {(r["table_name"], r["column_name"]): r for r in profiles}
    out = []
    for (table, column), s in by.items():
        for key in keys:
            t = by[key]
            if table == key[0] and (not self_references or column == key[1]):
                out.append((Pair(table, column, *key), "same-column"))
                continue
            pair = Pair(table, column, *key, name_similarity(column, key[0]))
            reason = ""
            if s["num_rows"] == 0 or s["null_count"] == s["num_rows"]:
                reason = "empty"
            elif OTHER in (s["family"], t["family"]) or s["family"] != t["family"]:
                reason = "type"
            elif pair.name_match > 0:
                reason = ""
            elif None not in (s["distinct_count"], t["distinct_count"]) and s["distinct_count"] > t["distinct_count"]:
                reason = "cardinality"
            else:
                for k in ("num", "text"):
                    lo, hi, lo2, hi2 = s[f"min_{k}"], s[f"max_{k}"], t[f"min_{k}"], t[f"max_{k}"]
                    if None not in (lo, hi, lo2, hi2) and (lo < lo2 or hi > hi2):
                        reason = "range"
            out.append((pair, reason))
    return out


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType | T.DateType | T.TimestampType | T.TimestampNTZType)


def as_long(column, kind: T.DataType):
    """Whole numbers as they are, times in microseconds."""
    return column.cast("long") if isinstance(kind, T.IntegralType) else F.unix_micros(column.cast("timestamp"))


def as_text(column, kind: T.DataType):
    """Equal values of any two numeric types, or of any two temporal ones, become equal texts."""
    if _whole(kind):
        return as_long(column, kind).cast("string")
    if isinstance(kind, T.DecimalType):
        return F.when(column == F.floor(column), column.cast("decimal(38,0)").cast("string")).otherwise(column.cast("double").cast("string"))
    if isinstance(kind, T.FractionalType):
        x = column.cast("double")
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return column.cast("string")


def _distinct(catalog: Catalog, wanted: dict[tuple[str, str], int], convert) -> DataFrame:
    """(c, v): the distinct non-null values of every wanted column under its number."""
    values = None
    for table in sorted({t for t, _ in wanted}):
        df = catalog.tables[table]
        cells = F.array(*[F.struct(F.lit(i).alias("c"), convert(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for (t, c), i in wanted.items() if t == table])
        d = df.select(F.inline(cells)).where("v is not null").distinct()
        values = d if values is None else values.unionByName(d)
    return values


def containment(catalog: Catalog, pairs: list[Pair]) -> DataFrame:
    """source, column_name, target, target_column, src_distinct, missing, containment for every pair, in one job.

    Pairs of whole numbers or of times are compared, and shuffled, as longs;
    others as texts in which equal numbers of different types are equal.
    """
    spark = catalog.spark
    if not pairs:
        return spark.createDataFrame([], "source string, column_name string, target string, target_column string, src_distinct long, missing long, containment double")
    columns = sorted({(p.source, p.column) for p in pairs} | {(p.target, p.target_column) for p in pairs})
    number = {c: i for i, c in enumerate(columns)}
    kind = {(t, c): catalog.tables[t].schema[c].dataType for t, c in columns}
    counts = None
    for whole, convert in ((True, as_long), (False, as_text)):
        own = [p for p in pairs if (_whole(kind[p.source, p.column]) and _whole(kind[p.target, p.target_column])) == whole]
        if not own:
            continue
        asked = spark.createDataFrame([(number[p.source, p.column], number[p.target, p.target_column]) for p in own], "s int, t int").distinct()
        values = _distinct(catalog, {c: number[c] for c in columns if any(c in ((p.source, p.column), (p.target, p.target_column)) for p in own)}, convert)
        wanted = values.join(F.broadcast(asked), F.col("c") == F.col("s")).select("s", "t", "v")  # pairs of columns, as many as the schema has
        met = wanted.join(values.select(F.col("c").alias("t"), "v", F.lit(1).alias("hit")), ["t", "v"], "left")
        met = met.groupBy("s", "t").agg(F.count(F.lit(1)).alias("src_distinct"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missing"))
        counts = met if counts is None else counts.unionByName(met)
    listed = spark.createDataFrame([(number[p.source, p.column], number[p.target, p.target_column]) for p in pairs], "s int, t int")
    names = spark.createDataFrame([(i, t, c) for (t, c), i in number.items()], "i int, tn string, cn string")
    out = listed.join(counts, ["s", "t"], "left").fillna(0, ["src_distinct", "missing"])
    out = out.join(F.broadcast(names.toDF("s", "source", "column_name")), "s").join(F.broadcast(names.toDF("t", "target", "target_column")), "t")
    ratio = F.when(F.col("src_distinct") > 0, (F.col("src_distinct") - F.col("missing")) / F.col("src_distinct")).otherwise(F.lit(0.0))
    return out.select("source", "column_name", "target", "target_column", "src_distinct", "missing", ratio.alias("containment"))


def score(name_match: float, popular: int, source_is_key: bool, target_is_key: bool) -> float:
    """Confidence of a verified inclusion, 0 to 1."""
    s = 0.15 + 0.7 * name_match + (0.1 if popular >= 2 else 0.0)
    if name_match < 0.5:
        s -= (0.3 if source_is_key else 0.0) + (0.2 if target_is_key else 0.0)
    return min(1.0, max(0.0, s))


def foreign_keys(catalog: Catalog, profiles: list, keys: list[tuple[str, str]], found: list) -> list[Link]:
    """Links from collected containment rows: verified by data, or by an exact name and a declared key."""
    profile = {(r["table_name"], r["column_name"]): r for r in profiles}
    declared = {(k.table, k.columns[0]) for k in catalog.keys if k.primary and len(k.columns) == 1}
    key_set = set(keys)
    verified = [r for r in found if r["src_distinct"] > 0 and r["containment"] >= MIN_CONTAINMENT]
    popularity: dict[tuple[str, str], int] = {}
    for r in verified:
        popularity[r["target"], r["target_column"]] = popularity.get((r["target"], r["target_column"]), 0) + 1
    out = []
    for r in found:
        if r["src_distinct"] <= 0:
            continue
        source, target = (r["source"], r["column_name"]), (r["target"], r["target_column"])
        match = name_similarity(r["column_name"], r["target"])
        kind = "self-reference" if r["source"] == r["target"] else "foreign-key"
        one = "one-to-one" if profile[source]["uniqueness_ratio"] == 1 else "one-to-many"
        if r["containment"] >= MIN_CONTAINMENT:
            s = score(match, popularity[target], source in key_set, target in key_set)
            out.append(Link(*source, *target, r["containment"], s, kind, one, "name" if match >= 0.5 else "data"))
        elif match >= RECOVER_SIMILARITY and target in declared:
            out.append(Link(*source, *target, r["containment"], RECOVER_SCORE, kind, one, "name", False))
    return out


def many_to_many(links: list[Link], pair_keys: list[tuple[str, tuple[str, str]]]) -> list[Link]:
    """Pairs of tables joined by a table whose two-column key is made of a link into each."""
    by = {(x.source, x.column): x for x in links if x.kind == "foreign-key"}
    out = []
    for table, (a, b) in pair_keys:
        x, y = by.get((table, a)), by.get((table, b))
        if x and y and x.target != y.target:
            out.append(replace(x, source=x.target, column=x.target_column, target=y.target, target_column=y.target_column, kind="many-to-many", cardinality="many-to-many", junction=table, score=min(x.score, y.score), containment=min(x.containment, y.containment)))
    return out


def trusted(catalog: Catalog, links: list[Link], least: float = TRUSTED) -> list[tuple[str, str, str, str]]:
    """Declared links and those a plan may rely on, each once."""
    rows = [(x.table, x.column, x.target, x.target_column) for x in catalog.links]
    rows += [(x.source, x.column, x.target, x.target_column) for x in links if x.kind == "foreign-key" and (x.evidence in ("declared", "name") or x.score >= least)]
    return list(dict.fromkeys(rows))


Columns = tuple[str, str]


def composite_containment(catalog: Catalog, pairs: list[tuple[str, Columns, str, Columns]]) -> DataFrame:
    """i, src_distinct, missing, containment of distinct value pairs for every (child, columns, parent, columns), in one job."""
    sides = sorted({(t, cs) for p in pairs for t, cs in (p[:2], p[2:])})
    number, values = {x: i for i, x in enumerate(sides)}, None
    for table in sorted({t for t, _ in sides}):
        df = catalog.tables[table]
        cells = F.array(*[F.struct(F.lit(number[table, cs]).alias("c"), *[as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"k{j}") for j, c in enumerate(cs)]) for t, cs in sides if t == table])
        d = df.select(F.inline(cells)).dropna().distinct()
        values = d if values is None else values.unionByName(d)
    listed = catalog.spark.createDataFrame([(i, number[p[:2]], number[p[2:]]) for i, p in enumerate(pairs)], "i int, s int, t int")
    asked = values.join(F.broadcast(listed), F.col("c") == F.col("s")).select("i", "t", "k0", "k1")  # pairs of the schema
    met = asked.join(values.select(F.col("c").alias("t"), "k0", "k1", F.lit(1).alias("hit")), ["t", "k0", "k1"], "left")
    counts = met.groupBy("i").agg(F.count(F.lit(1)).alias("src_distinct"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missing"))
    return counts.withColumn("containment", (F.col("src_distinct") - F.col("missing")) / F.col("src_distinct"))


def composite_foreign_keys(catalog: Catalog, links: list[tuple[str, str, str, str]], pair_keys: list[tuple[str, Columns]], singles: set[tuple[str, str]]) -> list[dict]:
    """Two-column links: both columns refer to the same two parents on either side, and the target pair is a minimal key.

    Tables of any size, all candidates in one job. For each (child, parent)
    the pair of best containment stays, the first one of equals.
    """
    refs: dict[str, dict[str, list[str]]] = {}
    for source, column, target, _ in links:
        refs.setdefault(source, {}).setdefault(target, []).append(column)
    wanted = []
    for parent, (a, b) in pair_keys:
        if (parent, a) in singles or (parent, b) in singles:
            continue
        of = {c: t for t, cs in refs.get(parent, {}).items() for c in cs}
        if a in of and b in of and of[a] != of[b]:
            wanted += [(child, (x, y), parent, (a, b)) for child in refs if child != parent for x in refs[child].get(of[a], []) for y in refs[child].get(of[b], []) if x != y]
    found = {r["i"]: r for r in composite_containment(catalog, wanted).collect()} if wanted else {}  # a row for each candidate of the schema
    best: dict[tuple[str, str], dict] = {}
    for i, (child, own, parent, key) in enumerate(wanted):
        r = found.get(i)
        if r and r["containment"] >= MIN_CONTAINMENT and r["containment"] > best.get((child, parent), {"containment": -1})["containment"]:
            best[child, parent] = {"child": child, "columns": list(own), "parent": parent, "parent_columns": list(key), "containment": r["containment"]}
    return list(best.values())
