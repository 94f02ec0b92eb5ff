"""From a request to one DataFrame.

The tables joined are those the request reads and what connects them, nothing
else: an inner join that is not read can still multiply or drop rows, so this
is a decision about meaning that no optimizer may take. Predicate and column
pushdown, join strategy and order are left to Catalyst.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as C, DataFrame, Window, functions as F

from ..operators.facts import NUMBER
from .ir import Filter, Request, RequestError, parse
from .model import Join, Metric, Model

_QUALIFIED = re.compile(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b")
_STRING = re.compile(r"'(?:[^']|'')*'")


@dataclass
class Fold:
    """A table of running totals, reduced to the last row of each series before anything else reads it."""

    table: str
    partition: list[str]
    order: str
    join: Join | None = None  # to the calendar that is folded in
    exposed: tuple[str, ...] = ()


@dataclass
class Compiled:
    frame: DataFrame
    sql: str
    tables: list[str]
    trace: list[str] = field(default_factory=list)


def minimal_tree(joins: list[Join], needed: set[str]) -> list[Join]:
    """The part of a join tree (or of a graph's breadth-first tree) that connects ``needed``."""
    if len(needed) < 2:
        return []
    start = min(needed)
    came: dict[str, tuple[str, Join] | None] = {start: None}
    line = deque([start])
    while line:
        t = line.popleft()
        for j in joins:
            o = j.other(t) if j.on else None
            if o is not None and o not in came:
                came[o] = (t, j)
                line.append(o)
    if missing := needed - set(came):
        raise RequestError("unreachable", f"no join reaches {', '.join(sorted(missing))}", min(missing))
    kept: dict[str, Join] = {}
    for t in sorted(needed):
        while came[t] is not None:
            up, j = came[t]
            kept.setdefault(t, j)
            t = up
    return [kept[t] for t in came if t in kept]


def formula_columns(formula: str, tables: set[str]) -> list[tuple[str, str]]:
    """Qualified columns of a metric's formula, string literals left out."""
    return [(t, c) for t, c in _QUALIFIED.findall(_STRING.sub("''", formula)) if t in tables]


def check_formula(metric: Metric, model: Model) -> list[str]:
    """What is wrong with a formula: unknown columns, or numbers kept as text that are not cast."""
    found = []
    for t, c in formula_columns(metric.formula, set(model.classes)):
        column = model.column(t, c)
        if column is None:
            found.append(f"unknown column {t}.{c}")
        elif column.numeric_text and not re.search(rf"cast\s*\(\s*{t}\.{c}\b", metric.formula, re.I):
            found.append(f"{t}.{c} is text and needs a cast")
    if not formula_columns(metric.formula, set(model.classes)) and "." in metric.formula:
        found.append("no column of a known table")
    return found


def _folds(request: Request, model: Model) -> dict[str, Fold]:
    out: dict[str, Fold] = {}
    for m in request.measures:
        if not m.property:
            continue
        table, name = parse(m.property)
        column = model.column(table, name)
        if column.temporality != "cumulative-snapshot" or table in out:
            continue
        if column.evidence is None:
            raise RequestError("temporality-no-evidence", f"{table}.{name} is cumulative, but nothing says by what", f"{table}.{name}")
        local = {c.name for c in model.classes[table]}
        grain = [*column.evidence.partition, column.evidence.order]
        away = tuple(g for g in dict.fromkeys(grain) if g not in local)
        fold = Fold(table, list(column.evidence.partition), column.evidence.order)
        if away:
            joins = [j for j in model.joins if j.other(table) and set(away) <= {c.name for c in model.classes[j.other(table)]}]
            if not joins:
                raise RequestError("temporality-unreachable", f"no joined table has {', '.join(away)}", f"{table}.{name}")
            fold.join, fold.exposed = joins[0], away
        out[table] = fold
    return out


def _on(j: Join, left: str) -> C:
    right = j.other(left)
    pairs = j.on if left == j.source else [(b, a) for a, b in j.on]
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{a}") == F.col(f"{right}.{b}") for a, b in pairs])


def _literal(value, kind: str) -> C:
    """A literal of the column's family, so the column, and not the literal, decides the comparison."""
    if kind == "numeric" and isinstance(value, str):
        if not re.match(NUMBER, value):
            raise RequestError("filter-type", f"{value!r} is no number", value)
        return F.lit(float(value))
    return F.lit(value)


def _sql_literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def compile_request(request: Request, model: Model, tables: dict[str, DataFrame]) -> Compiled:
    """The request as a lazy DataFrame, with an SQL text of the same plan for display.

    Raises RequestError with a code: scope-table, scope-column,
    scope-capability, capability-no-formula, unreachable, distinct-order,
    temporality-*, filter-type.
    """
    trace: list[str] = []
    for iri in request.properties:
        t, c = parse(iri)
        if t not in model.classes:
            raise RequestError("scope-table", f"table {t} is not in scope", t)
        if model.column(t, c) is None:
            raise RequestError("scope-column", f"column {t}.{c} is not in scope", iri)
    metrics: dict[str, Metric] = {}
    for m in request.measures:
        if m.capability:
            metric = model.metric(m.capability)
            if metric is None:
                raise RequestError("scope-capability", f"capability {m.capability} is not in scope", m.capability)
            if not metric.formula:
                raise RequestError("capability-no-formula", f"capability {m.capability} has no formula", m.capability)
            metrics[m.capability] = metric
    if request.distinct and any(o.property and o.property not in request.select for o in request.order_by):
        raise RequestError("distinct-order", "a distinct projection is ordered by what it selects only")

    folds = _folds(request, model)
    needed = {parse(i)[0] for i in request.properties}
    for metric in metrics.values():
        needed |= set(metric.tables) & set(model.classes) | {t for t, _ in formula_columns(metric.formula, set(model.classes))}
    hidden = {}  # a calendar's columns that a fold offers in its place
    for f in folds.values():
        trace.append(f"keep the last {f.order} of each ({', '.join(f.partition)}) in {f.table}")
        calendar = f.join.other(f.table) if f.join else None
        if calendar in needed:
            read = {c for t, c in map(parse, request.properties) if t == calendar}
            if read <= set(f.exposed):
                needed.discard(calendar)
                hidden[calendar] = f.table
    joins = minimal_tree(model.joins, needed)
    read = set(needed) | {t for j in joins for t in (j.source, j.target)}
    if dropped := set(model.classes) - read:
        trace.append(f"not read: {', '.join(sorted(dropped))}")

    def place(iri: str) -> tuple[str, str]:
        t, c = parse(iri)
        return hidden.get(t, t), c

    def value(iri: str, numeric: bool = False) -> C:
        t, c = place(iri)
        x = F.col(f"{t}.{c}")
        return x.cast("double") if numeric and model.column(*parse(iri)).numeric_text else x

    def text(iri: str, numeric: bool = False) -> str:
        t, c = place(iri)
        return f"CAST({t}.{c} AS DOUBLE)" if numeric and model.column(*parse(iri)).numeric_text else f"{t}.{c}"

    def relation(t: str) -> DataFrame:
        d = tables[t]
        f = folds.get(t)
        if f is None:
            return d.alias(t)
        if f.join is not None:
            cal = f.join.other(t)
            pairs = f.join.on if t == f.join.source else [(b, a) for a, b in f.join.on]
            keys = [F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]
            cut = tables[cal].select(*keys, *f.exposed)
            d = d.join(cut, reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(pairs)])).drop(*[f"__k{i}" for i in range(len(pairs))])
        last = Window.partitionBy(*f.partition).orderBy(F.col(f.order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in sorted(x.name for x in model.classes[t] if x.key)])
        return d.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn").alias(t)

    def relation_sql(t: str) -> str:
        f = folds.get(t)
        if f is None:
            return t
        own, cal = f"{t}.*", ""
        if f.join is not None:
            o = f.join.other(t)
            pairs = f.join.on if t == f.join.source else [(b, a) for a, b in f.join.on]
            own += "".join(f", {o}.{c}" for c in f.exposed)
            cal = f" JOIN {o} ON " + " AND ".join(f"{t}.{a} = {o}.{b}" for a, b in pairs)
        return f"(SELECT * FROM (SELECT {own}, ROW_NUMBER() OVER (PARTITION BY {', '.join(f.partition)} ORDER BY {f.order} DESC) AS rn FROM {t}{cal}) x WHERE rn = 1) {t}"

    first = min(needed)
    done, frame, sql = {first}, relation(first), f"FROM {relation_sql(first)}"
    rest = list(joins)
    while rest:
        j = next(j for j in rest if j.source in done or j.target in done)
        rest.remove(j)
        left = j.source if j.source in done else j.target
        right = j.other(left)
        frame = frame.join(relation(right), _on(j, left), "inner")
        pairs = j.on if left == j.source else [(b, a) for a, b in j.on]
        sql += f" JOIN {relation_sql(right)} ON " + " AND ".join(f"{left}.{a} = {right}.{b}" for a, b in pairs)
        done.add(right)

    where = []
    for f in request.filters:
        frame = frame.where(_condition(f, model, value))
        number = not isinstance(f.value, (str, list, tuple)) or f.op in ("<", "<=", ">", ">=")
        right = "(" + ", ".join(map(_sql_literal, f.value)) + ")" if f.op == "IN" else _sql_literal(f.value)
        where.append(f"{text(f.property, number and f.op != 'LIKE')} {f.op} {right}")

    names: set[str] = set()

    def unique(name: str) -> str:
        out, n = name, 2
        while out in names:
            out, n = f"{name}_{n}", n + 1
        names.add(out)
        return out

    shown: dict[str, str] = {}
    if request.select:
        cols = []
        for i in request.select:
            shown[i] = unique(place(i)[1])
            cols.append((value(i).alias(shown[i]), f"{text(i)} AS {shown[i]}"))
        if request.distinct:
            frame = frame.select(*[c for c, _ in cols]).distinct()
            frame = _ordered(frame, request, lambda o: F.col(o.alias or shown[o.property]))
        else:
            frame = _ordered(frame, request, lambda o: _by_alias(o.alias, shown, value) if o.alias else value(o.property, True))
            frame = frame.limit(request.limit) if request.limit else frame
            frame = frame.select(*[c for c, _ in cols])
        head, tail = "SELECT " + ("DISTINCT " if request.distinct else "") + ", ".join(s for _, s in cols), ""
        if request.distinct and request.limit:
            frame = frame.limit(request.limit)
    else:
        keys, aggs = [], []
        for i in request.group_by:
            shown[i] = unique(place(i)[1])
            keys.append((value(i).alias(shown[i]), f"{text(i)} AS {shown[i]}"))
        for m in request.measures:
            if m.capability:
                alias = unique(m.alias or re.sub(r"\W", "_", m.capability.split("/")[-1]))
                aggs.append((F.expr(metrics[m.capability].formula).alias(alias), f"{metrics[m.capability].formula} AS {alias}"))
            else:
                alias = unique(m.alias or f"{m.fn.lower()}_{parse(m.property)[1]}")
                aggs.append((getattr(F, m.fn.lower())(value(m.property, m.fn != "COUNT")).alias(alias), f"{m.fn}({text(m.property, m.fn != 'COUNT')}) AS {alias}"))
        extra = [(value(o.property).alias(f"__o{n}"), o) for n, o in enumerate(request.order_by) if o.property and o.property not in shown]
        if extra:
            raise RequestError("order-scope", "an aggregation is ordered by its keys and measures only", extra[0][1].property)
        frame = frame.groupBy(*[c for c, _ in keys]).agg(*[c for c, _ in aggs])
        frame = _ordered(frame, request, lambda o: F.col(o.alias or shown[o.property]))
        frame = frame.limit(request.limit) if request.limit else frame
        head = "SELECT " + ", ".join(s for _, s in [*keys, *aggs])
        tail = " GROUP BY " + ", ".join(str(i + 1) for i in range(len(keys))) if keys else ""
    if where:
        sql += " WHERE " + " AND ".join(where)
    sql = f"{head} {sql}{tail}"
    if request.order_by:
        sql += " ORDER BY " + ", ".join(f"{o.alias or shown.get(o.property) or text(o.property, True)} {'DESC' if o.descending else 'ASC'} NULLS {o.nulls or ('FIRST' if o.descending else 'LAST')}" for o in request.order_by)
    if request.limit:
        sql += f" LIMIT {request.limit}"
    return Compiled(frame, sql, sorted(done), trace)


def _by_alias(alias: str, shown: dict[str, str], value) -> C:
    for iri, name in shown.items():
        if name == alias:
            return value(iri, True)
    raise RequestError("order-scope", f"no column is called {alias}", alias)


def _ordered(frame: DataFrame, request: Request, column) -> DataFrame:
    """Nulls go last when ascending and first when descending, unless the request says otherwise."""
    by = []
    for o in request.order_by:
        x = column(o)
        first = o.nulls == "FIRST" or o.nulls is None and o.descending
        by.append((x.desc_nulls_first() if first else x.desc_nulls_last()) if o.descending else (x.asc_nulls_first() if first else x.asc_nulls_last()))
    return frame.orderBy(*by) if by else frame


def _condition(f: Filter, model: Model, value) -> C:
    kind = model.column(*parse(f.property)).kind
    if f.op == "IN":
        return value(f.property).isin([v if kind != "numeric" else float(v) for v in f.value])
    if f.op == "LIKE":
        return value(f.property).like(f.value)
    number = not isinstance(f.value, str) or f.op in ("<", "<=", ">", ">=")
    x, y = value(f.property, number), _literal(f.value, kind)
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[f.op]
