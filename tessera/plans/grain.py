"""Which of several tables that carry a measure a request means, told from the shape of the request."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .ir import Request, parse
from .model import Model

ASOF, LATEST, EVENTS, ROWS, NONE = "as-of-event", "max-or-latest", "agg-over-events", "per-row", "none"


@dataclass
class Resolved:
    request: Request
    shape: str = NONE
    moved: tuple[str, str] | None = None  # table before, table after
    ambiguous: list[str] = field(default_factory=list)


def pin_columns(model: Model) -> set[str]:
    """Columns that single out an event: join keys, and what series are grouped and ordered by."""
    out = {c for j in model.joins for pair in j.on for c in pair}
    for columns in model.classes.values():
        for c in columns:
            if c.evidence:
                out |= {*c.evidence.partition, c.evidence.order}
    return out


def shape(request: Request, column: str, model: Model) -> str:
    """What the request does with ``column``; a request pinned to one event comes before anything else."""
    if column not in {parse(i)[1] for i in request.properties}:
        return NONE
    aliases = {m.alias or f"{m.fn.lower()}_{column}" for m in request.measures if m.property and parse(m.property)[1] == column}
    ordered = any((o.property and parse(o.property)[1] == column) or o.alias in aliases for o in request.order_by)
    pins = pin_columns(model)
    if any(f.op == "=" and parse(f.property)[1] != column and parse(f.property)[1] in pins for f in request.filters):
        return ASOF
    if request.limit == 1 and request.order_by and not ordered:
        return ASOF
    own = [m.fn for m in request.measures if m.property and parse(m.property)[1] == column]
    if ordered or any(f in ("MAX", "MIN") for f in own):
        return LATEST
    if own:
        return EVENTS
    return ROWS if column in {parse(i)[1] for i in request.select} else NONE


def grain_of(model: Model, table: str, column: str) -> str:
    """cumulative, snapshot or event."""
    c = model.column(table, column)
    return {"cumulative-snapshot": "cumulative", "as-of-event-snapshot": "snapshot"}.get(c.temporality, "event") if c else ""


def siblings(model: Model, table: str, column: str) -> list[str]:
    """Tables with a column of this name that refer to the same entities as ``table``."""
    def parents(t: str) -> set[str]:
        return {j.target for j in model.joins if j.source == t}

    return sorted(t for t in model.classes if t != table and model.column(t, column) and parents(t) & parents(table))


#: The grain that a shape asks for; the other shapes ask for none.
WANTED = {LATEST: ("cumulative", "snapshot"), EVENTS: ("event",)}


def resolve(request: Request, model: Model) -> Resolved:
    """Move measures to the one sibling table whose grain fits, or say that several do; entities are never exchanged."""
    out = Resolved(request)
    for iri in dict.fromkeys(request.properties):
        table, column = parse(iri)
        near = siblings(model, table, column)
        if not near or model.column(table, column).key or column in pin_columns(model):
            continue
        out.shape = shape(request, column, model)
        wanted = WANTED.get(out.shape)
        if wanted is None:
            if out.shape in (ASOF, ROWS) and len({grain_of(model, t, column) for t in [table, *near]}) > 1:
                out.ambiguous.append(iri)
            continue
        if grain_of(model, table, column) in wanted:
            continue
        fits = [t for t in near if grain_of(model, t, column) in wanted]
        if len(fits) == 1:
            new = model.iri(fits[0], column)
            swap = lambda i, iri=iri, new=new: new if i == iri else i
            r = out.request
            out.request = replace(
                r,
                select=tuple(map(swap, r.select)),
                group_by=tuple(map(swap, r.group_by)),
                measures=tuple(replace(m, property=swap(m.property)) if m.property else m for m in r.measures),
                filters=tuple(replace(f, property=swap(f.property)) for f in r.filters),
                order_by=tuple(replace(o, property=swap(o.property)) if o.property else o for o in r.order_by),
            )
            out.moved = (table, fits[0])
        elif fits:
            out.ambiguous.append(iri)
    return out
