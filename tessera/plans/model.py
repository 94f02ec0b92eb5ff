"""What a plan may speak of: classes with columns, joins between them, named metrics."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Evidence:
    """Why a column is tagged: how rows of one series are grouped and ordered."""

    partition: tuple[str, ...]
    order: str


@dataclass
class Column:
    name: str
    kind: str = "numeric"  # family of its type
    label: str = ""
    samples: tuple[str, ...] = ()
    distinct: int | None = None
    numeric_text: bool = False
    temporality: str = ""  # cumulative-snapshot, as-of-event-snapshot
    evidence: Evidence | None = None
    key: bool = False

    @property
    def enumerable(self) -> bool:
        """Whether ``samples`` is the whole domain."""
        return bool(self.samples) and self.distinct is not None and self.distinct <= len(self.samples)


@dataclass(frozen=True)
class Join:
    source: str
    target: str
    on: tuple[tuple[str, str], ...]
    cardinality: str = "many-to-one"
    confidence: float = 1.0
    provenance: str = "declared"  # discovered, inferred-name, co-reference
    iri: str = ""

    @property
    def name(self) -> str:
        return self.iri or f"{self.source}.{'+'.join(a for a, _ in self.on)}->{self.target}"

    def other(self, table: str) -> str | None:
        return self.target if table == self.source else self.source if table == self.target else None


@dataclass(frozen=True)
class Metric:
    iri: str
    formula: str
    tables: tuple[str, ...]
    label: str = ""
    description: str = ""
    unit: str = ""


@dataclass
class Model:
    """The tables, joins and metrics in scope, of a whole ontology or of the part chosen for one question."""

    classes: dict[str, list[Column]]
    joins: list[Join] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    prefix: str = "tsr"

    def column(self, table: str, name: str) -> Column | None:
        return next((c for c in self.classes.get(table, ()) if c.name == name), None)

    def metric(self, iri: str) -> Metric | None:
        return next((m for m in self.metrics if m.iri == iri), None)

    def iri(self, table: str, column: str) -> str:
        return f"{self.prefix}:property/{table}/{column}"

    def sub(self, tables: set[str]) -> Model:
        return Model({t: c for t, c in self.classes.items() if t in tables}, [j for j in self.joins if {j.source, j.target} <= tables], [m for m in self.metrics if set(m.tables) <= tables], self.prefix)
