"""Typed query requests: projection, ranking or aggregation, and their check against what is in scope."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.text import normalize
from .model import Model

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "IN", "LIKE")
GROUNDED = ("=", "!=", "IN")


class RequestError(ValueError):
    """A request that breaks a rule; ``code`` names the rule, ``where`` the part."""

    def __init__(self, code: str, message: str, where: str = ""):
        super().__init__(message)
        self.code, self.where = code, where


@dataclass(frozen=True)
class Measure:
    capability: str | None = None
    fn: str | None = None
    property: str | None = None
    alias: str | None = None

    def __post_init__(self):
        if (self.capability is None) == (self.fn is None):
            raise RequestError("measure", "a measure is either a capability or a function of a property")
        if self.fn is not None and (self.fn not in FUNCTIONS or not self.property):
            raise RequestError("measure", f"function {self.fn} of {self.property}")


@dataclass(frozen=True)
class Filter:
    property: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise RequestError("filter", f"operator {self.op}")
        if (self.op == "IN") != isinstance(self.value, (list, tuple)):
            raise RequestError("filter", "IN takes a list, other operators one value")


@dataclass(frozen=True)
class Order:
    alias: str | None = None
    property: str | None = None
    descending: bool = False
    nulls: str | None = None  # FIRST, LAST

    def __post_init__(self):
        if (self.alias is None) == (self.property is None):
            raise RequestError("order", "order by either an alias or a property")


@dataclass(frozen=True)
class Request:
    """``select`` alone projects, with ``order_by`` it ranks; ``measures`` aggregate."""

    select: tuple[str, ...] = ()
    distinct: bool = False
    measures: tuple[Measure, ...] = ()
    group_by: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None

    def __post_init__(self):
        if bool(self.select) == bool(self.measures):
            raise RequestError("shape", "a request has either select or measures")
        if self.select and self.group_by:
            raise RequestError("shape", "a projection has no group_by")
        if self.measures and self.distinct:
            raise RequestError("shape", "an aggregation has no distinct")
        if self.limit is not None and self.limit < 1:
            raise RequestError("shape", "limit starts at 1")

    @property
    def properties(self) -> list[str]:
        return [*self.select, *self.group_by, *(f.property for f in self.filters), *(o.property for o in self.order_by if o.property), *(m.property for m in self.measures if m.property)]


def parse(iri: str) -> tuple[str, str]:
    """Table and column of a property, its last two path segments."""
    parts = iri.split("/")
    if len(parts) < 2:
        raise RequestError("scope-column", f"no property: {iri}", iri)
    return parts[-2], parts[-1]


@dataclass
class Checked:
    request: Request
    issues: list[tuple[str, str]] = field(default_factory=list)  # where, message


def leash(request: Request, model: Model, pool: int = 15) -> Checked:
    """Whether all names are in scope and literals are values that enumerable columns have.

    A literal that matches only after normalising is replaced by the value as
    stored; one that does not match is an issue that lists some values.
    """
    out = Checked(request)
    for iri in dict.fromkeys(request.properties):
        if model.column(*parse(iri)) is None:
            out.issues.append((iri, f"property not in scope: {iri}"))
    for m in request.measures:
        if m.capability and model.metric(m.capability) is None:
            out.issues.append((m.capability, f"capability not in scope: {m.capability}"))
    filters = []
    for f in request.filters:
        column = model.column(*parse(f.property))
        if column is None or not column.enumerable or f.op not in GROUNDED:
            filters.append(f)
            continue
        values = list(f.value) if isinstance(f.value, (list, tuple)) else [f.value]
        for i, v in enumerate(values):
            if not isinstance(v, str) or v in column.samples:
                continue
            same = next((s for s in column.samples if normalize(s) == normalize(v)), None)
            if same is None:
                out.issues.append((f.property, f"{v!r} is no value of {column.name}; values: {', '.join(column.samples[:pool])}"))
            else:
                values[i] = same
        filters.append(replace(f, value=tuple(values) if isinstance(f.value, (list, tuple)) else values[0]))
    out.request = replace(request, filters=tuple(filters))
    return out
