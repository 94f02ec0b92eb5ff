"""A question's words linked to the schema by rules alone, and the query they make.

Four passes claim words, each taking the longest runs first: phrases that the
evidence explains, stored values, names, and bare numbers beside a column that
was named. A word claimed once is not read again. What is linked becomes an
intent (measures, dimensions, columns to show, filters, order) and that a
request, which the compiler turns into a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.text import ASCENDING, CUES, DESCENDING, PROJECTION_CUES, direction, normalize, number_word, raw_tokens, similarity, singularize, tokenize
from . import compiler, routing
from .evidence import Evidence
from .ir import Filter, Measure, Order, Request, parse
from .model import Model

#: Scores and bounds of a link (fixed values).
FLOOR, COMMENT, VALUE, FUZZY, BAND, SURE, ALIAS_COVER = 0.6, 0.72, 0.95, 0.82, 0.05, 0.9, 0.6
RANK = {"measure": 3, "dimension": 2, "entity": 1, "attribute": 0}
GROUPING = {"by", "per", "each", "group", "grouped"}


@dataclass(frozen=True)
class Target:
    """What a word may stand for."""

    role: str  # entity, measure, dimension, attribute
    table: str
    column: str = ""
    names: tuple[str, ...] = ()
    values: tuple[tuple[str, str], ...] = ()  # normalised and stored
    metric: str = ""
    comment: tuple[str, ...] = ()

    @property
    def element(self) -> tuple[str, str]:
        return self.table, self.column or self.metric


def _names(*texts: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for text in texts if (t := " ".join(tokenize(text.replace("_", " "))))))


def targets(model: Model, labels: dict[str, list[str]] | None = None) -> list[Target]:
    """Tables are entities, columns of a one-column metric measures, enumerable columns that are no keys or numbers dimensions, others attributes."""
    more, out, measured = labels or {}, [], {}
    for m in model.metrics:
        read = set(compiler.formula_columns(m.formula, set(model.classes)))
        table, column = next(iter(read)) if len(read) == 1 else (m.tables[0] if m.tables else "", "")
        if column:
            measured[table, column] = m.iri
        out.append(Target("measure", table, column, _names(m.label, m.iri.split("/")[-1].replace("-", " ")), metric=m.iri, comment=tuple(tokenize(m.description))))
    for table, columns in model.classes.items():
        out.append(Target("entity", table, names=_names(table, *more.get(table, []))))
        for c in columns:
            values = tuple((n, v) for v in c.samples if (n := normalize(v)))
            role = "measure" if (table, c.name) in measured else "dimension" if values and not c.key and c.kind != "numeric" else "attribute"
            out.append(Target(role, table, c.name, _names(c.name, c.label, *more.get(f"{table}.{c.name}", [])), values, measured.get((table, c.name), "")))
    return out


def name_score(words: list[str], t: Target) -> float:
    """1 for the name itself, up to 0.89 for some of its words, 0.8 for a part, up to 0.9 for a slip, 0.72 for words of its comment."""
    span, best = " ".join(words), 0.0
    for name in t.names:
        own = name.split()
        if span == name:
            return 1.0
        if len(words) < len(own) and set(words) <= set(own):
            best = max(best, 0.76 + 0.13 * len(words) / len(own))
        elif len(span) >= 4 and span in name:
            best = max(best, 0.8)
        elif len(words) == len(own) == 1 and (near := similarity(span, name)) >= FUZZY:
            best = max(best, min(0.9, near))
    return best or (COMMENT if len(words) > 1 and t.comment and set(words) <= set(t.comment) else 0.0)


@dataclass
class Link:
    target: Target
    start: int
    size: int
    score: float
    via: str  # alias, value, name
    value: str = ""


@dataclass
class Intent:
    links: list[Link] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    measures: list[Target] = field(default_factory=list)
    dimensions: list[tuple[str, str]] = field(default_factory=list)
    projection: list[tuple[str, str]] = field(default_factory=list)
    filters: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    order: tuple[Target, bool] | None = None  # descending?
    limit: int | None = None
    ambiguous: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)


def _framing(word: str) -> bool:
    return word in CUES | PROJECTION_CUES | DESCENDING | ASCENDING | {"first", "last"}


class _Reader:
    """Words of a question and who has claimed them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.by: list[Link | None] = [None] * len(words)
        self.links: list[Link] = []

    def open_spans(self, most: int):
        """Runs of unclaimed words, the longest first, then from the left."""
        for size in range(min(most, len(self.words)), 0, -1):
            for start in range(len(self.words) - size + 1):
                if not any(self.by[start : start + size]):
                    yield start, size

    def claim(self, link: Link) -> None:
        self.links.append(link)
        self.by[link.start : link.start + link.size] = [link] * link.size


def link_question(question: str, model: Model, labels: dict[str, list[str]] | None = None, hints: Evidence | None = None) -> Intent:
    """The intent that the words alone tell, with what was ambiguous or not understood.

    Candidates within 0.05 of the best one make a span ambiguous if the best
    is at 0.9 or more; the best is taken. A superlative without a grouping
    word ranks rows (order and limit, 1 unless a number is said) instead of
    aggregating. Keys and linking columns are never shown or grouped by.
    """
    pool, out = targets(model, labels), Intent()
    raw = raw_tokens(question)
    words = [singularize(w) for w in raw]
    reader, literal = _Reader(words), [w.isascii() and w.isdigit() for w in raw]
    of = {t.element: t for t in reversed(pool) if not t.metric or t.column}
    aliases = [(tokenize(phrase), parse(iri)) for phrase, iri in (hints.aliases if hints else {}).items()]
    for start, size in reader.open_spans(3):
        own = set(words[start : start + size])
        hit = next((e for phrase, e in aliases if phrase and own <= set(phrase) and len(own) >= ALIAS_COVER * len(phrase)), None)
        if hit in of:
            reader.claim(Link(of[hit], start, size, 1.0, "alias"))
    for start, size in reader.open_spans(2):
        if any(literal[start : start + size]):
            continue
        span = " ".join(raw[start : start + size])
        owners = {t.element: (t, stored) for t in pool if t.column for n, stored in t.values if n == span}
        if owners:
            if len(owners) > 1:
                out.ambiguous.append((span, list(owners)))
            t, stored = next(iter(owners.values()))
            reader.claim(Link(t, start, size, VALUE, "value", stored))
    for start, size in reader.open_spans(3):
        own = words[start : start + size]
        if all(map(_framing, own)):
            continue
        best: dict[tuple[str, str], tuple[float, int, Target]] = {}
        for t in pool:
            s = name_score(own, t)
            if s >= FLOOR and (s, RANK[t.role]) > best.get(t.element, (0.0, -1))[:2]:
                best[t.element] = (s, RANK[t.role], t)
        if best:
            ranked = sorted(best.values(), key=lambda x: -x[0])
            top = ranked[0][0]
            near = [t.element for s, _, t in ranked if s >= top - BAND]
            if len(near) > 1 and top >= SURE:
                out.ambiguous.append((" ".join(own), near))
            reader.claim(Link(ranked[0][2], start, size, top, "name"))
    bound = {}
    for i, is_number in enumerate(literal):  # a number belongs to the column named just before it
        beside = next((x for x in (reader.by[j] for j in (i - 1, i - 2) if j >= 0) if x), None)
        if is_number and reader.by[i] is None and beside:
            table, column = beside.target.table, beside.target.column or next((c.name for c in model.classes.get(beside.target.table, []) if c.key), "")
            if column:
                bound[i] = (table, column)
    out.links = reader.links
    _assemble(out, model, question, raw, words, bound, hints)
    out.unresolved = list(dict.fromkeys(w for i, w in enumerate(raw) if reader.by[i] is None and i not in bound and len(w) >= 3 and not _framing(w) and number_word(w) is None))
    return out


def _assemble(out: Intent, model: Model, question: str, raw: list[str], words: list[str], bound: dict[int, tuple[str, str]], hints: Evidence | None) -> None:
    said = set(raw)
    grouping = bool(said & GROUPING)
    top = next((w for w in words if w in DESCENDING | ASCENDING), None)
    joined = {(t, c) for j in model.joins for a, b in j.on for t, c in ((j.source, a),)}
    keys = {(t, c.name) for t, cs in model.classes.items() for c in cs if c.key} | joined
    tables = dict.fromkeys(x.target.table for x in out.links)
    ranked: list[Target] = []
    for x in out.links:
        t, place = x.target, (x.target.table, x.target.column)
        if x.via == "value":
            out.filters.setdefault(place, [])
            if x.value not in out.filters[place]:
                out.filters[place].append(x.value)
        elif t.role == "measure":
            to = ranked if top and not grouping and t.column else out.measures
            if t.element not in [m.element for m in to]:
                to.append(t)
        elif t.column and (grouping or t.role == "dimension") and place not in keys and place not in out.dimensions:
            out.dimensions.append(place)
    for i, place in bound.items():
        out.filters.setdefault(place, []).append(raw[i])
        tables[place[0]] = None
    for f in hints.filters if hints else []:
        out.filters.setdefault(parse(f.property), []).append(f.value)
        tables[parse(f.property)[0]] = None
    if hints and hints.order:
        table, column = parse(hints.order.property)
        out.order, out.limit = (Target("attribute", table, column), hints.order.descending), hints.limit
        tables[table] = None
    elif top:
        by = ranked[0] if ranked else out.measures[0] if out.measures else None
        if by:
            out.order = (by, direction(top) == "desc")
    if top and out.limit is None:
        out.limit = next((n for i, w in enumerate(raw) if i not in bound and (n := number_word(w)) is not None), 1)
    ordered = {(out.order[0].table, out.order[0].column)} if out.order else set()
    if set(normalize(question).split()) & PROJECTION_CUES:
        taken = set(out.filters) | ordered | {(m.table, m.column) for m in out.measures} | keys
        taken |= set(out.dimensions) if out.measures else set()
        shown = [(x.target.table, x.target.column) for x in out.links if x.via == "name" and x.target.column and x.target.role != "measure"]
        out.projection = [c for c in dict.fromkeys(shown) if c not in taken]
    out.dimensions = [d for d in out.dimensions if d not in out.filters] if out.measures else []
    out.tables = list(tables)


def to_request(intent: Intent, model: Model) -> Request:
    """Dimensions, columns and measures, or every column if there is none of them; MAX stands for the sum of a running total."""
    measures = []
    for i, m in enumerate(intent.measures):
        alias = "value" if i == 0 else f"value_{i + 1}"
        if m.metric:
            measures.append(Measure(capability=m.metric, alias=alias))
        else:
            running = model.column(m.table, m.column).temporality == "cumulative-snapshot"
            measures.append(Measure(fn="MAX" if running else "SUM", property=model.iri(m.table, m.column), alias=alias))
    where = tuple(Filter(model.iri(*place), "IN" if len(v) > 1 else "=", tuple(v) if len(v) > 1 else v[0]) for place, v in intent.filters.items())
    shown = tuple(model.iri(*c) for c in [*intent.dimensions, *intent.projection])
    order = ()
    if intent.order:
        by, descending = intent.order
        named = next((x.alias for x, m in zip(measures, intent.measures, strict=True) if m.element == by.element), None)
        order = (Order(alias=named, descending=descending) if named else Order(property=model.iri(by.table, by.column), descending=descending),)
    if measures:
        return Request(measures=tuple(measures), group_by=shown, filters=where, order_by=order, limit=intent.limit if shown else None)
    every = tuple(model.iri(t, c.name) for t in intent.tables for c in model.classes[t])
    return Request(select=shown or every, filters=where, order_by=order, limit=intent.limit)


def warnings(intent: Intent, model: Model) -> list[str]:
    path = routing.join_path(model.joins, intent.tables) if len(intent.tables) > 1 else None
    out = []
    if not (intent.measures or intent.projection):
        out.append("no column, measure or dimension was linked: all columns are shown")
    for m in intent.measures:
        c = model.column(m.table, m.column) if m.column else None
        if c is not None and c.temporality == "cumulative-snapshot":
            grain = f"; its last value in each ({', '.join(c.evidence.partition)}) by {c.evidence.order} is exact" if c.evidence else ""
            out.append(f"{c.name} is a running total: MAX is taken, not SUM{grain}")
    if len(intent.tables) > 1 and path is None:
        out.append(f"not connected: {', '.join(intent.tables)}")
    if path and path.fan_out and intent.measures:
        out.append("rows are multiplied by a join: an aggregate may count them twice")
    if path and path.low_confidence:
        out.append("a join of low confidence is used")
    if intent.unresolved:
        out.append(f"not understood: {', '.join(intent.unresolved)}")
    if intent.ambiguous:
        out.append(f"ambiguous, the best was taken: {', '.join(s for s, _ in intent.ambiguous)}")
    return out


@dataclass
class Linked:
    intent: Intent
    frame: DataFrame
    sql: str
    warnings: list[str]


def answer(question: str, model: Model, tables: dict[str, DataFrame], labels: dict[str, list[str]] | None = None, hints: Evidence | None = None) -> Linked:
    """The question's rows by linking alone. Raises RequestError where the tables do not connect; ValueError if nothing was linked."""
    intent = link_question(question, model, labels, hints)
    if not intent.tables:
        raise ValueError("no word of the question names anything of the schema")
    done = compiler.compile_request(to_request(intent, model), model, tables)
    return Linked(intent, done.frame, done.sql, warnings(intent, model))


def anchored_columns(found) -> dict[str, list[str]]:
    """Columns of each table that hits of ``anchor.anchor`` name or hold a value of."""
    out: dict[str, dict[str, None]] = {}
    for h in found.hits:
        if h.kind in ("property", "value"):
            out.setdefault(h.table, {})[h.name] = None
    return {t: list(c) for t, c in out.items()}


def trim(model: Model, terminals: list[str], anchored: dict[str, list[str]], most: int = 15) -> Model:
    """The model with what a prompt needs of each table: joining and anchored columns, and for terminals those with samples.

    Only terminals keep samples, all of them where they are the whole domain,
    else ``most``. Physical columns are pruned by Catalyst; this one trims
    what a planner is shown.
    """
    linking = {(t, c) for j in model.joins for a, b in j.on for t, c in ((j.source, a), (j.target, b))}
    classes = {}
    for table, columns in model.classes.items():
        own, kept = set(anchored.get(table, [])), []
        for c in columns:
            if c.name in own or (table, c.name) in linking or table in terminals and c.samples:
                samples = (c.samples if c.enumerable else c.samples[:most]) if table in terminals else ()
                kept.append(type(c)(**{**c.__dict__, "samples": samples}))
        classes[table] = kept
    return Model(classes, model.joins, model.metrics, model.prefix)


