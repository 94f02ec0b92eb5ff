"""From tables to a checked ontology: profile, link, tag, name, assemble, validate."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..operators import facts, inclusion, profile, temporality
from ..sources.catalog import TEXT, Catalog
from . import ontology
from .model import Column, Evidence, Join, Metric, Model

#: Names a table's columns: {column: (label, description)}; columns it leaves out are named by their identifiers.
Namer = Callable[[str, list[str]], dict[str, tuple[str, str]]]
#: Proposes metrics for a model, given what was wrong with the last ones.
MetricMaker = Callable[[Model, list[str]], list[Metric]]

_RUNNING = re.compile(r"\b(running|cumulative|season|so far|to date|standing|after each)\b", re.I)
_TOTAL = re.compile(r"\b(points|total|amount|wins|count)\b", re.I)


@dataclass
class Built:
    model: Model
    data: ontology.Dataset
    problems: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)  # probes that did not run

    @property
    def status(self) -> str:
        return "partial" if self.problems or self.failures else "success"


def discover(catalog: Catalog, enum_most: int = 50) -> tuple[Model, list[inclusion.Link], list[str]]:
    """Classes, columns and joins from data and declared constraints. A probe that fails is noted and left out."""
    failures: list[str] = []
    rows = profile.profile(catalog).collect()  # a row for each column of the schema
    singles = [(r["table_name"], r["column_name"]) for r in rows if r["num_rows"] and r["uniqueness_ratio"] == 1]
    kept = [p for p, reason in inclusion.prefilter(rows, singles) if not reason]
    links = inclusion.foreign_keys(catalog, rows, singles, inclusion.containment(catalog, kept).collect())
    trusted = inclusion.trusted(catalog, links)
    by = {(r["table_name"], r["column_name"]): r for r in rows}
    keys = {(k.table, c) for k in catalog.keys if len(k.columns) == 1 for c in k.columns} | set(singles)
    classes: dict[str, list[Column]] = {}
    for table in sorted(catalog.tables):
        texts = [c.name for c in catalog.columns(table) if c.family == TEXT and (table, c.name) not in keys and 0 < (by[table, c.name]["distinct_count"] or 0) <= enum_most]
        values: dict[str, list[str]] = {}
        if texts:
            for v in facts.value_dictionary(catalog, table, texts, enum_most).collect():  # enum_most values for each column at most
                values.setdefault(v["column_name"], []).append(v["value"])
        numeric = {r["column_name"] for r in facts.numeric_text(catalog, table).collect() if r["is_numeric_text"]} if any(c.family == TEXT for c in catalog.columns(table)) else set()
        classes[table] = [Column(c.name, c.family, samples=tuple(sorted(values.get(c.name, []))), distinct=by[table, c.name]["distinct_count"], numeric_text=c.name in numeric, key=(table, c.name) in keys) for c in catalog.columns(table)]
    for table in classes:
        plan = temporality.sequence_plan(catalog, table, trusted)
        if plan is None:
            continue
        names = temporality.measures(catalog, plan, {c for t, c in singles if t == table})
        if not names:
            continue
        try:
            running = {r["measure"] for r in temporality.monotonic(catalog, plan, names).collect() if r["is_cumulative"]}
            standing = set()
            if temporality.grain_is_unique(catalog, plan).collect()[0]["is_unique"]:
                standing = {r["measure"] for r in temporality.von_neumann(catalog, plan, names).collect() if r["is_snapshot"]} - running
        except Exception as e:  # noqa: BLE001 - one probe is not worth the build
            failures.append(f"{table}: {type(e).__name__}")
            continue
        evidence = Evidence((*plan.entities, *([plan.season] if plan.season else [])), plan.order)
        for c in classes[table]:
            if c.name in running | standing:
                c.temporality, c.evidence = ("cumulative-snapshot" if c.name in running else "as-of-event-snapshot"), evidence
    declared = {(x.table, x.column, x.target, x.target_column) for x in catalog.links}
    joins = [Join(s, t, ((c, tc),), ontology.cardinality((s, c) in keys, (t, tc) in keys)) for s, c, t, tc in sorted(declared)]
    for x in links:
        if (x.source, x.column, x.target, x.target_column) not in declared:
            unique = ontology.cardinality((x.source, x.column) in keys, (x.target, x.target_column) in keys, x.cardinality)
            joins.append(Join(x.source, x.target, ((x.column, x.target_column),), unique, x.score, "inferred-name" if x.evidence == "name" else "discovered"))
    try:
        joins += _pair_joins(catalog, rows, links, trusted, set(singles))
    except Exception as e:  # noqa: BLE001
        failures.append(f"pairs: {type(e).__name__}")
    return Model(classes, joins), links, failures


def _pair_joins(catalog: Catalog, rows: list, links: list[inclusion.Link], trusted: list[tuple[str, str, str, str]], singles: set[tuple[str, str]]) -> list[Join]:
    """Two-column links, many to one, and tables that a junction joins, many to many.

    Only pairs of columns that refer to two other tables can make either, so
    only those are probed for being a key. The junction's own links stay the
    way that rows are joined; the join over it says what it means.
    """
    refs: dict[str, dict[str, str]] = {}
    for source, column, target, _ in trusted:
        if target != source:
            refs.setdefault(source, {})[column] = target
    pair_keys = []
    for table, own in sorted(refs.items()):
        if len(set(own.values())) > 1:
            wanted = [r for r in rows if r["table_name"] == table and r["column_name"] in own]
            found = profile.composite_keys(catalog, table, wanted).collect()  # pairs of referring columns
            pair_keys += [(table, tuple(r["columns"])) for r in found if own[r["columns"][0]] != own[r["columns"][1]]]
    out = []
    for x in inclusion.composite_foreign_keys(catalog, trusted, pair_keys, singles):
        on = tuple(zip(x["columns"], x["parent_columns"], strict=True))
        out.append(Join(x["child"], x["parent"], on, "many-to-one", round(x["containment"], 9), "discovered"))
    known = {(x.source, x.column) for x in links}
    declared = [inclusion.Link(x.table, x.column, x.target, x.target_column, 1.0, 1.0, evidence="declared") for x in catalog.links if (x.table, x.column) not in known]
    for x in inclusion.many_to_many([*links, *declared], pair_keys):
        out.append(Join(x.source, x.target, (), "many-to-many", x.score, "discovered", f"{x.junction}.{x.source}-{x.target}"))
    return out


def build(catalog: Catalog, namer: Namer | None = None, metrics: MetricMaker | None = None, retries: int = 2, freeze: list[ontology.Node] | None = None) -> Built:
    """A tiered ontology with what is wrong with it.

    Metrics that break a rule, or that Spark's analyzer refuses, are asked for
    again; those that pass are marked as validated.
    """
    model, _, failures = discover(catalog)
    for table, columns in model.classes.items():
        named = namer(table, [c.name for c in columns]) if namer else {}
        for c in columns:
            c.label = named.get(c.name, ("", ""))[0] or ontology.humanize(c.name)
    issues: list[str] = []
    for _ in range(retries + 1):
        model.metrics = [m for m in (metrics(model, issues) if metrics else []) if set(m.tables) <= set(model.classes)]
        model = ontology.add_revenue(model)
        nodes = ontology.prune_alt_labels(ontology.assemble(model))
        problems = ontology.validate(nodes, model)
        own = {m.iri for m in model.metrics}
        refused = {m.iri: e for m in model.metrics if m.iri in own and (e := ontology.dry_run(m, model, catalog.tables))}
        problems += [(i, e) for i, es in refused.items() for e in es]
        issues = [f"{i}: {e}" for i, e in problems if i in own]
        if not issues or metrics is None:
            break
    broken = {i for i, _ in problems}
    # a formula that Spark's analyzer has accepted, and no rule refuses, is worth more than a proposed one
    nodes = [replace(n, provenance="validated") if n.kind == "metric" and n.iri in own - broken else n for n in nodes]
    if freeze:
        nodes = frozen(nodes, freeze)
    return Built(model, ontology.tier(nodes), problems, warnings(nodes), failures)


def warnings(nodes: list[ontology.Node]) -> list[str]:
    """Running totals whose comment does not say so."""
    return [f"{n.iri}: a running total described as if each row counted by itself" for n in nodes if n.get("temporality") == "cumulative-snapshot" and n.comment and _TOTAL.search(n.comment) and not _RUNNING.search(n.comment)]


def frozen(fresh: list[ontology.Node], old: list[ontology.Node]) -> list[ontology.Node]:
    """Fresh nodes with the wording of an older build; the older build's metrics replace the fresh ones as a whole."""
    before = {n.iri: n for n in old}
    kept = [replace(n, label=before[n.iri].label, alt=before[n.iri].alt, comment=before[n.iri].comment) if n.iri in before else n for n in fresh if n.kind != "metric"]
    return kept + [n for n in old if n.kind == "metric"]
