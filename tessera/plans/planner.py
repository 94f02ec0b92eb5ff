"""From a question to rows: anchor, prune, route, plan, resolve, compile. Any planner can be plugged in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from . import anchor, compiler, grain, routing
from .evidence import menu
from .ir import Request, RequestError, leash, parse
from .model import Model

#: A planner gets the question, the menu and the issues of its last try, and returns a request or None.
Planner = Callable[[str, str, list[str]], Request | None]


@dataclass
class Answer:
    frame: DataFrame | None = None
    sql: str = ""
    request: Request | None = None
    tables: list[str] = field(default_factory=list)
    failed: str = ""  # stage that failed
    message: str = ""
    trace: list[str] = field(default_factory=list)


def ground_request(request: Request, model: Model) -> tuple[Request | None, list[str]]:
    """A request from outside, cut down to what exists: unknown parts go and are reported; None if nothing is left."""
    notes: list[str] = []

    def known(iri: str) -> bool:
        try:
            ok = model.column(*parse(iri)) is not None
        except RequestError:
            ok = False
        if not ok:
            notes.append(f"dropped {iri}")
        return ok

    parts = {
        "select": tuple(i for i in request.select if known(i)), "group_by": tuple(i for i in request.group_by if known(i)),
        "measures": tuple(m for m in request.measures if (known(m.property) if m.property else model.metric(m.capability) is not None)),
        "filters": tuple(f for f in request.filters if known(f.property)), "order_by": tuple(o for o in request.order_by if not o.property or known(o.property)),
    }
    if not parts["select"] and not parts["measures"]:
        return None, notes
    return replace(request, **parts), notes


def sql_fallback(question: str, shown: str, writer: Callable[[str, str], str], tables: dict[str, DataFrame]) -> Answer:
    """Free SQL from a writer over the tables of a slice; analyzed before it is returned."""
    out = Answer(trace=["free SQL"])
    try:
        out.sql = writer(question, shown)
        out.frame = next(iter(tables.values())).sparkSession.sql(out.sql)
    except Exception as e:  # noqa: BLE001
        out.failed, out.message = "sql", f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return out


def rule_planner(model: Model, index: anchor.Index) -> Planner:
    """Plans by the words of the question alone."""
    return lambda question, shown, issues: None if issues else anchor.link(question, model, index)[0]


def rescue_siblings(model: Model, kept: list[str], found: anchor.Anchors) -> list[str]:
    """Also keep tables that refer to the same parents as a kept one and share a hit column with it."""
    def parents(t: str) -> set[str]:
        return {j.target for j in model.joins if j.source == t and j.provenance == "declared"}

    hit = {(h.table, h.name) for h in found.of("property")}
    more = [
        t for t in found.terminals
        if t not in kept and parents(t) and any(parents(t) == parents(k) and any(model.column(k, n) and not model.column(k, n).key for x, n in hit if x == t) for k in kept)
    ]
    return [*kept, *more]


def ask(question: str, model: Model, tables: dict[str, DataFrame], planner: Planner | None = None, index: anchor.Index | None = None, retries: int = 2) -> Answer:
    """The answer as a lazy DataFrame, or the stage that failed and why; nothing is raised for a bad question."""
    index = index or anchor.build_index(model)
    planner = planner or rule_planner(model, index)
    out = Answer()
    found = anchor.anchor(question, index)
    terminals = rescue_siblings(model, anchor.prune(found, index), found)
    out.trace.append(f"terminals: {', '.join(terminals)}")
    if not terminals:
        out.failed, out.message = "anchor", "no word of the question names anything"
        return out
    g = routing.steiner(model.joins, terminals)
    if not g.connected:
        out.failed, out.message = "subgraph", f"no trusted joins connect {', '.join(terminals)}"
        return out
    scope = Model({t: model.classes[t] for t in g.tables}, g.joins, [m for m in model.metrics if set(m.tables) <= set(g.tables)], model.prefix)
    issues: list[str] = []
    for _ in range(retries + 1):
        try:
            request = planner(question, menu(scope, g.tables), issues)
        except Exception as e:  # noqa: BLE001 - a planner may fail in its own ways
            request, issues = None, [f"{type(e).__name__}: {e}"]
            continue
        if request is None:
            issues = issues or ["no plan"]
            continue
        checked = leash(request, scope)
        issues = [m for _, m in checked.issues]
        if not issues:
            request = checked.request
            break
    if request is None or issues:
        out.failed, out.message = "planner", "; ".join(issues)
        return out
    resolved = grain.resolve(request, scope)
    out.request = resolved.request
    try:
        c = compiler.compile_request(resolved.request, scope, tables)
    except RequestError as e:
        out.failed, out.message = "compiler", f"{e.code}: {e}"
        return out
    out.frame, out.sql, out.tables = c.frame, c.sql, c.tables
    out.trace += c.trace
    return out
