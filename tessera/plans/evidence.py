"""Hints written beside a question, and what a language model is shown of the schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import normalize, number_word
from .ir import Filter, Order
from .model import Model


@dataclass
class Evidence:
    aliases: dict[str, str] = field(default_factory=dict)  # phrase -> property
    filters: list[Filter] = field(default_factory=list)
    order: Order | None = None
    limit: int | None = None
    unread: list[str] = field(default_factory=list)


_REFERS = re.compile(r"^(.+?)\s+refers?\s+to\s+(.+)$", re.I)
_EQUALS = re.compile(r"^([\w.]+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|(-?\d+(?:\.\d+)?))$")
_EXTREME = re.compile(r"^\(?(max|min)\)?\s*\(?\s*([\w.]+)\s*\)?$", re.I)


def _column(name: str, model: Model) -> str | None:
    table, _, column = name.rpartition(".")
    owners = [t for t in sorted(model.classes) if (not table or t == table) and model.column(t, column)]
    return model.iri(owners[0], column) if len(owners) == 1 or owners and table else None


def parse_evidence(text: str, model: Model) -> Evidence:
    """Clauses "X refers to Y", "column = value", "MAX(column)"; any other is reported as unread."""
    out = Evidence()
    for clause in filter(None, (c.strip() for c in re.split(r"[;\n]", text))):
        body, phrase = clause, None
        if m := _REFERS.match(clause):
            phrase, body = m[1], m[2].strip()
        if m := _EQUALS.match(body):
            iri = _column(m[1], model)
            if iri:
                value = next(v for v in (m[2], m[3], m[4]) if v is not None)
                out.filters.append(Filter(iri, "=", float(value) if m[4] else value))
        elif m := _EXTREME.match(body):
            iri = _column(m[2], model)
            if iri:
                out.order = Order(property=iri, descending=m[1].lower() == "max")
                number = next((n for w in normalize(phrase or "").split() if (n := number_word(w)) is not None), 1)
                out.limit = number
        else:
            iri = _column(body, model)
        if iri and phrase:
            out.aliases[normalize(phrase)] = iri
        if not iri:
            out.unread.append(clause)
    return out


def grounding_slice(model: Model, seeds: list[str], budget: int | None = None) -> list[str]:
    """The seeds and, in order of name, tables one join away: two more if there are three seeds or more, else six."""
    budget = budget if budget is not None else 2 if len(seeds) >= 3 else 6
    near = sorted({j.other(s) for s in seeds for j in model.joins if j.other(s)} - set(seeds))
    return [*seeds, *near[:budget]]


def menu(model: Model, tables: list[str], most_values: int = 15) -> str:
    """What a planner may use, one line for each property and metric; exactly what ``leash`` allows."""
    lines = []
    for t in tables:
        for c in model.classes[t]:
            grain = f" [{c.temporality}]" if c.temporality else ""
            values = f" values: {', '.join(c.samples[:most_values])}" if c.samples else ""
            lines.append(f"{model.iri(t, c.name)} ({c.kind}){grain}{' ' + c.label if c.label else ''}{values}")
    lines += [f"{m.iri} = {m.label}{': ' + m.description[:160] if m.description else ''}" for m in model.metrics if set(m.tables) <= set(tables)]
    return "\n".join(lines)


def tokens(text: str) -> int:
    return -(-len(text) // 4)
