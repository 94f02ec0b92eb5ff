"""From the words of a question to tables, columns and values."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.text import ASCENDING, CUES, DESCENDING, direction, normalize, number_word, raw_tokens, similarity, spans, tokenize
from .ir import Filter, Measure, Order, Request
from .model import Model

#: Scores and bounds of a match (fixed values).
FLOOR, DESCRIBED, EXACT_VALUE, FUZZY, FUZZY_LENGTH, MOST = 0.6, 0.72, 0.95, 0.82, 4, 8


#: Superlatives that mean a date (fixed values).
DATE_WORDS = {"latest": "desc", "newest": "desc", "youngest": "desc", "earliest": "asc", "oldest": "asc"}


@dataclass(frozen=True)
class Surface:
    """A name by which a table, column or metric may be called."""

    text: str
    kind: str  # class, property, metric
    table: str
    name: str = ""
    described: bool = False

    @property
    def tokens(self) -> list[str]:
        return self.text.split()


@dataclass
class Index:
    surfaces: list[Surface]
    values: dict[str, list[tuple[str, str, str]]]  # normalized value -> (table, column, value as stored)


@dataclass(frozen=True)
class Hit:
    kind: str
    table: str
    name: str
    span: str
    score: float
    value: str = ""


@dataclass
class Anchors:
    terminals: list[str] = field(default_factory=list)
    hits: list[Hit] = field(default_factory=list)

    def of(self, kind: str) -> list[Hit]:
        return [h for h in self.hits if h.kind == kind]


def build_index(model: Model, labels: dict[str, list[str]] | None = None) -> Index:
    """Names and labels of everything in the model, and the values of enumerable columns that are no numbers."""
    out, values = [], {}

    def add(text: str, kind: str, table: str, name: str = "", described: bool = False) -> None:
        if t := " ".join(tokenize(text)):
            out.append(Surface(t, kind, table, name, described))

    for table, columns in model.classes.items():
        for text in [table.replace("_", " "), *(labels or {}).get(table, [])]:
            add(text, "class", table)
        for c in columns:
            for text in dict.fromkeys([c.name.replace("_", " "), c.label, *(labels or {}).get(f"{table}.{c.name}", [])]):
                add(text, "property", table, c.name)
            for v in c.samples:
                if (n := normalize(v)) and not n.replace(" ", "").isdigit():
                    values.setdefault(n, []).append((table, c.name, v))
    for m in model.metrics:
        for text in (m.label, m.iri.split("/")[-1].replace("-", " ")):
            add(text, "metric", m.tables[0] if m.tables else "", m.iri)
        add(m.description, "metric", m.tables[0] if m.tables else "", m.iri, True)
    return Index(out, values)


def label_score(span: str, s: Surface) -> float:
    """How well a span names a surface: the same 1, some of its words 0.76 to 0.89, part of it 0.8, a slip of the pen up to 0.9."""
    words = span.split()
    if s.described:
        return DESCRIBED if len(words) > 1 and set(words) <= set(s.tokens) else 0.0
    if span == s.text:
        return 1.0
    if len(words) < len(s.tokens) and set(words) <= set(s.tokens):
        return 0.76 + 0.13 * len(words) / len(s.tokens)
    if len(span) >= 4 and span in s.text:
        return 0.8
    if len(words) == len(s.tokens) == 1 and (near := similarity(span, s.text)) >= FUZZY:
        return min(0.9, near)
    return 0.0


def anchor(question: str, index: Index, most: int = MOST) -> Anchors:
    """Hits of every run of up to three words; tables by their best hit, ``most`` at most (a rule of the scoring: what is left out stays in ``hits``)."""
    best: dict[tuple, Hit] = {}

    def keep(h: Hit) -> None:
        k = (h.kind, h.table, h.name, h.value)
        if k not in best or h.score > best[k].score:
            best[k] = h

    for span in spans(tokenize(question)):
        for s in index.surfaces:
            score = label_score(span, s)
            if span in CUES and score < 1:
                continue
            if score >= FLOOR:
                keep(Hit(s.kind, s.table, s.name, span, score))
    for span in spans(raw_tokens(question)):
        if span in index.values:
            for t, c, v in index.values[span]:
                keep(Hit("value", t, c, span, EXACT_VALUE, v))
        elif len(span) >= FUZZY_LENGTH and index.values:
            near, key = max((similarity(span, k), k) for k in index.values)
            if FUZZY <= near < 1:
                for t, c, v in index.values[key]:
                    keep(Hit("value", t, c, span, near, v))
    hits = sorted(best.values(), key=lambda h: (-h.score, h.table, h.name, h.value))
    score: dict[str, float] = {}
    for h in hits:
        if h.table:
            score[h.table] = max(score.get(h.table, 0.0), h.score)
    return Anchors(sorted(score, key=lambda t: (-score[t], t))[:most], hits)


def prune(found: Anchors, index: Index, rare: int = 2) -> list[str]:
    """Terminals named exactly, holding a value, or hit by a word that few tables share; all of them if that leaves none."""
    spread: dict[str, set[str]] = {}
    for h in found.hits:
        spread.setdefault(h.span, set()).add(h.table)
    kept = [
        t for t in found.terminals
        if any(h.table == t and (h.kind == "class" and h.score == 1 or h.kind == "value" or len(spread[h.span]) <= rare and h.score >= 0.8) for h in found.hits)
    ]
    return kept or found.terminals


def superlative(question: str, model: Model, tables: list[str]) -> tuple[str, str, str] | None:
    """(table, column, direction) for words like "latest" when exactly one table in view has exactly one date; opposites cancel."""
    ends = {DATE_WORDS[w] for w in normalize(question).split() if w in DATE_WORDS}
    dated = [(t, [c.name for c in model.classes[t] if c.kind == "temporal" and not c.name.endswith("id")]) for t in tables]
    dated = [(t, cs[0]) for t, cs in dated if len(cs) == 1]
    return (*dated[0], ends.pop()) if len(ends) == 1 and len(dated) == 1 else None


def path_notes(path) -> list[str]:
    """Warnings about a join path: what it may multiply, and joins that are not trusted."""
    if path is None:
        return ["the tables are not connected"]
    out = [f"{j.name} is {j.cardinality}: rows of {j.target} may count more than once" for j in path.joins if j.cardinality not in ("one-to-one", "many-to-one")]
    return out + (["a join of low confidence is used"] if path.low_confidence else [])


def link(question: str, model: Model, index: Index) -> tuple[Request | None, list[str]]:
    """A request told from the words alone, and what stayed unclear.

    Metrics hit by name are measured; text columns asked for by "by", "per" or
    "each" are grouped by; values filter; superlatives with a number limit.
    Without a metric, named columns are projected. Keys are never shown.
    """
    found, notes = anchor(question, index), []
    words = normalize(question).split()
    metrics = [h for h in found.of("metric") if h.score >= 0.8]
    metrics = [h for h in metrics if h.score == metrics[0].score][:1]
    filters: dict[tuple[str, str], list[str]] = {}
    for h in found.of("value"):
        if h.score == EXACT_VALUE and h.value not in filters.setdefault((h.table, h.name), []):
            filters[h.table, h.name].append(h.value)
    for span in {h.span for h in found.of("value")}:
        owners = sorted({(h.table, h.name) for h in found.of("value") if h.span == span and h.score == EXACT_VALUE})
        if len(owners) > 1:
            notes.append(f"{span!r} is a value of {', '.join('.'.join(o) for o in owners)}")
    columns = [h for h in found.of("property") if h.score >= 0.85 and not model.column(h.table, h.name).key and (h.table, h.name) not in filters]
    where = tuple(Filter(model.iri(t, c), "IN" if len(v) > 1 else "=", tuple(v) if len(v) > 1 else v[0]) for (t, c), v in sorted(filters.items()))
    top = next((w for w in words if w in DESCENDING | ASCENDING), None)
    limit = next((n for w in words if (n := number_word(w)) is not None), 1) if top else None
    if metrics:
        asked = [h for h in columns if model.column(h.table, h.name).kind != "numeric"]
        by = tuple(dict.fromkeys(model.iri(h.table, h.name) for h in asked)) if {"by", "per", "each"} & set(words) or top else ()
        order = (Order(alias="value", descending=direction(top) == "desc"),) if top else ()
        return Request(measures=(Measure(capability=metrics[0].name, alias="value"),), group_by=by, filters=where, order_by=order, limit=limit if by else None), notes
    sums = [h for h in columns if model.column(h.table, h.name).kind == "numeric"] if {"total", "sum", "average", "avg", "mean"} & set(words) else []
    if sums:  # a running total is read at its end, anything else is added up
        c = model.column(sums[0].table, sums[0].name)
        fn = "AVG" if {"average", "avg", "mean"} & set(words) else "MAX" if c.temporality == "cumulative-snapshot" else "SUM"
        by = tuple(dict.fromkeys(model.iri(h.table, h.name) for h in columns if model.column(h.table, h.name).kind != "numeric"))
        order = (Order(alias="value", descending=direction(top) == "desc"),) if top and by else ()
        return Request(measures=(Measure(fn=fn, property=model.iri(sums[0].table, sums[0].name), alias="value"),), group_by=by, filters=where, order_by=order, limit=limit if order else None), notes
    if columns:
        shown = tuple(dict.fromkeys(model.iri(h.table, h.name) for h in columns))
        numeric = [i for i, h in zip(shown, columns) if model.column(h.table, h.name).kind in ("numeric", "temporal")]
        order = (Order(property=numeric[0], descending=direction(top) == "desc"),) if top and numeric else ()
        return Request(select=shown, filters=where, order_by=order, limit=limit if order else None), notes
    return None, [*notes, "no metric or column was named"]
