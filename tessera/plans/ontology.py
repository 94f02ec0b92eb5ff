"""The semantic layer as a graph of nodes: assembled from profiles, checked, tiered, written and compared."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import normalize
from .compiler import check_formula
from .model import Column, Join, Metric, Model

ASSERTED = 0.5


@dataclass(frozen=True)
class Node:
    """One element: kind is class, property, relation or metric; ``extra`` holds what else is known."""

    iri: str
    kind: str
    label: str
    alt: tuple[str, ...] = ()
    comment: str = ""
    confidence: float = 1.0
    provenance: str = "declared"
    extra: tuple[tuple[str, object], ...] = ()

    def get(self, key: str, default=None):
        return dict(self.extra).get(key, default)


@dataclass
class Dataset:
    asserted: list[Node]
    candidates: list[Node] = field(default_factory=list)


def humanize(name: str) -> str:
    """A label from an identifier: words, the first one capitalised."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).replace("_", " ").split()
    return " ".join(words).capitalize()


def predicate(column: str) -> str:
    """A relation's name from its column: without ``_id``, in camel case."""
    first, *rest = [w for w in re.sub(r"_?id$", "", column, flags=re.I).split("_") if w] or [column]
    return first + "".join(w.capitalize() for w in rest)


def cardinality(source_unique: bool, target_unique: bool, known: str = "one-to-many") -> str:
    if not target_unique:
        return known
    return "one-to-one" if source_unique else "many-to-one"


def assemble(model: Model) -> list[Node]:
    """Nodes of a model; metric identifiers that clash get -2, -3 and so on."""
    out: list[Node] = []
    for table in sorted(model.classes):
        out.append(Node(f"{model.prefix}:class/{table}", "class", humanize(table)))
        for c in model.classes[table]:
            extra = [("kind", c.kind), ("key", c.key), ("numericText", c.numeric_text), ("temporality", c.temporality)]
            if c.samples:
                extra.append(("samples", tuple(c.samples)))
            out.append(Node(model.iri(table, c.name), "property", c.label or humanize(c.name), extra=(("domain", f"{model.prefix}:class/{table}"), *extra)))
    for j in model.joins:
        extra = [("domain", f"{model.prefix}:class/{j.source}"), ("range", f"{model.prefix}:class/{j.target}"), ("on", tuple("=".join(p) for p in j.on))]
        if j.confidence >= ASSERTED:
            extra.append(("cardinality", j.cardinality))
        out.append(Node(f"{model.prefix}:relation/{j.name}.{'+'.join(b for _, b in j.on)}", "relation", predicate(j.on[0][0]) if j.on else predicate(j.target), confidence=j.confidence, provenance=j.provenance, extra=tuple(extra)))
    seen: dict[str, int] = {}
    for m in model.metrics:
        seen[m.iri] = seen.get(m.iri, 0) + 1
        iri = m.iri if seen[m.iri] == 1 else f"{m.iri}-{seen[m.iri]}"
        out.append(Node(iri, "metric", m.label or humanize(m.iri.split("/")[-1].replace("-", "_")), comment=m.description, extra=(("formula", m.formula), ("tables", m.tables), ("unit", m.unit))))
    return dedupe(out)


def dedupe(nodes: Iterable[Node]) -> list[Node]:
    """Equal nodes become one; different nodes of one identifier are an error."""
    out: dict[str, Node] = {}
    for n in nodes:
        if out.setdefault(n.iri, n) != n:
            raise ValueError(f"two different nodes are called {n.iri}")
    return list(out.values())


def tier(nodes: list[Node], least: float = ASSERTED) -> Dataset:
    """Relations found in data alone and below ``least`` are candidates; all else is asserted."""
    weak = [n for n in nodes if n.kind == "relation" and n.provenance == "discovered" and n.confidence < least]
    return Dataset([n for n in nodes if n not in weak], weak)


def validate(nodes: list[Node], model: Model) -> list[tuple[str, str]]:
    """(identifier, what is wrong) for each broken rule."""
    classes = {n.iri for n in nodes if n.kind == "class"}
    out = []
    for n in nodes:
        for side in ("domain", "range"):
            if n.get(side) and n.get(side) not in classes:
                out.append((n.iri, f"{side} {n.get(side)} does not exist"))
        if n.kind == "metric":
            metric = Metric(n.iri, n.get("formula"), tuple(n.get("tables") or ()))
            out += [(n.iri, e) for e in check_formula(metric, model)]
            for t, c in re.findall(r"\bsum\s*\(\s*(\w+)\.(\w+)\s*\)", n.get("formula") or "", re.I):
                column = model.column(t, c)
                if column and column.temporality == "cumulative-snapshot":
                    out.append((n.iri, f"sums {t}.{c}, which is a running total"))
    scopes: dict[tuple, str] = {}
    for n in nodes:
        scope = (n.kind, n.get("domain") if n.kind == "property" else "", n.label)
        if n.kind != "relation" and scopes.setdefault(scope, n.iri) != n.iri:
            out.append((n.iri, f"label {n.label!r} is that of {scopes[scope]}"))
    used = {n.get("domain") for n in nodes} | {n.get("range") for n in nodes}
    out += [(c, "no property or relation") for c in sorted(classes - used)]
    return out


def dry_run(metric: Metric, model: Model, tables: dict[str, DataFrame]) -> list[str]:
    """What Spark's analyzer says of a formula over the tables it names; nothing is run.

    Tables without a join between them are not multiplied out: only their
    names and types matter here. A metric with a unit has to be a number.
    """
    names = [t for t in metric.tables if t in tables]
    if not names:
        return ["no table to resolve it against"]
    frame = tables[names[0]].limit(0).alias(names[0])
    for t in names[1:]:
        frame = frame.join(tables[t].limit(0).alias(t), F.lit(False))
    try:
        kind = frame.agg(F.expr(metric.formula).alias("value")).schema["value"].dataType
    except Exception as e:  # noqa: BLE001 - whatever the analyzer objects to
        return [str(e).split("\n")[0][:200]]
    return [f"unit {metric.unit} needs a number, not {kind.simpleString()}"] if metric.unit and not isinstance(kind, T.NumericType) else []


def prune_alt_labels(nodes: list[Node]) -> list[Node]:
    """Other labels go where another node has them for its own."""
    owners: dict[str, set[str]] = {}
    for n in nodes:
        owners.setdefault(normalize(n.label), set()).add(n.iri)
    return [replace(n, alt=tuple(a for a in n.alt if owners.get(normalize(a), {n.iri}) <= {n.iri})) for n in nodes]


def add_revenue(model: Model) -> Model:
    """A revenue metric, if none is called so and there are orders with a total and refunds with an amount."""
    if any("revenue" in normalize(m.label) for m in model.metrics):
        return model

    def column(stem: str, *names: str) -> str | None:
        for t in sorted(model.classes):
            if t.startswith(stem):
                hit = next((c.name for n in names for c in model.classes[t] if n in c.name and c.kind == "numeric"), None)
                if hit:
                    return f"{t}.{hit}"
        return None

    gross, back = column("order", "total", "amount"), column("refund", "amount", "total")
    if not gross or not back:
        return model
    tables = (gross.split(".")[0], back.split(".")[0])
    return replace(model, metrics=[*model.metrics, Metric(f"{model.prefix}:capability/revenue", f"SUM({gross}) - COALESCE(SUM({back}), 0)", tables, "Revenue")])


def header(source: str, knobs: dict[str, object], version: str = "1") -> dict:
    """Version, time, a fingerprint of the source without credentials, and the settings in use."""
    plain = re.sub(r"//[^@/]*@", "//", source)
    return {"version": version, "created": datetime.now(UTC).isoformat(timespec="seconds"), "source": hashlib.sha256(plain.encode()).hexdigest(), "knobs": dict(sorted(knobs.items()))}


def to_json(data: Dataset, head: dict | None = None) -> str:
    def one(n: Node) -> dict:
        return {"@id": n.iri, "@type": n.kind, "label": n.label, "alt": list(n.alt), "comment": n.comment, "confidence": n.confidence, "provenance": n.provenance, **{k: list(v) if isinstance(v, tuple) else v for k, v in n.extra}}

    return json.dumps({"header": head or {}, "@graph": [one(n) for n in data.asserted], "candidates": [one(n) for n in data.candidates]}, indent=1, ensure_ascii=False)


def from_json(text: str) -> Dataset:
    known = {"@id", "@type", "label", "alt", "comment", "confidence", "provenance"}

    def one(d: dict) -> Node:
        extra = tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in d.items() if k not in known)
        return Node(d["@id"], d["@type"], d["label"], tuple(d["alt"]), d["comment"], d["confidence"], d["provenance"], extra)

    raw = json.loads(text)
    return Dataset([one(d) for d in raw["@graph"]], [one(d) for d in raw["candidates"]])


def load_model(data: Dataset, prefix: str = "tsr", candidates: bool = False) -> Model:
    """The model back from nodes; candidate relations only if asked for."""
    m = Model({}, prefix=prefix)
    for n in [*data.asserted, *(data.candidates if candidates else [])]:
        if n.kind == "class":
            m.classes.setdefault(n.iri.split("/")[-1], [])
        elif n.kind == "property":
            table, name = n.iri.split("/")[-2:]
            samples = n.get("samples") or ()
            m.classes.setdefault(table, []).append(Column(name, n.get("kind"), n.label, samples, len(samples) or None, n.get("numericText"), n.get("temporality"), key=n.get("key")))
        elif n.kind == "relation":
            m.joins.append(Join(n.get("domain").split("/")[-1], n.get("range").split("/")[-1], tuple(tuple(p.split("=")) for p in n.get("on")), n.get("cardinality", "one-to-many"), n.confidence, n.provenance))
        else:
            m.metrics.append(Metric(n.iri, n.get("formula"), tuple(n.get("tables")), n.label, n.comment, n.get("unit")))
    return m


def _turtle_text(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


TYPES = {"class": "owl:Class", "property": "owl:DatatypeProperty", "relation": "owl:ObjectProperty", "metric": "tsr:Capability"}


def to_turtle(nodes: list[Node], base: str = "urn:tessera:") -> str:
    """Turtle 1.1, nodes in order of identifier."""
    out = [f"@prefix tsr: <{base}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix skos: <http://www.w3.org/2004/02/skos/core#> .", ""]
    for n in sorted(nodes, key=lambda n: n.iri):
        name = "<" + base + re.sub(r'[<>"{}|^`\\\s]', "_", n.iri.split(":", 1)[-1]) + ">"
        facts = [f"a {TYPES[n.kind]}", f"skos:prefLabel {_turtle_text(n.label)}", *(f"skos:altLabel {_turtle_text(a)}" for a in n.alt)]
        if n.comment:
            facts.append(f"rdfs:comment {_turtle_text(n.comment)}")
        for side in ("domain", "range"):
            if n.get(side):
                facts.append(f"rdfs:{side} <{base}{n.get(side).split(':', 1)[-1]}>")
        if n.get("formula"):
            facts.append(f"tsr:formula {_turtle_text(n.get('formula'))}")
        out.append(f"{name} " + " ;\n    ".join(facts) + " .")
    return "\n".join(out) + "\n"


def to_trig(data: Dataset, base: str = "urn:tessera:") -> str:
    """The asserted nodes as default graph, candidates in a graph of their own."""
    inner = to_turtle(data.candidates, base).split("\n\n", 1)[-1] if data.candidates else ""
    return to_turtle(data.asserted, base) + f"\n<{base}candidates> {{\n{inner}}}\n"


def to_mermaid(model: Model) -> str:
    lines = ["graph LR"] + [f"  {t}" for t in sorted(model.classes)]
    return "\n".join(lines + [f"  {j.source} -->|{'+'.join(a for a, _ in j.on)}| {j.target}" for j in sorted(model.joins, key=lambda j: j.name)]) + "\n"


def diff(before: list[Node], after: list[Node]) -> list[tuple[str, str, str]]:
    """(identifier, change, key) for every difference; a changed temporality is a change of its own kind."""
    a, b = {n.iri: n for n in before}, {n.iri: n for n in after}
    out = [(i, "added", "") for i in sorted(b.keys() - a.keys())] + [(i, "removed", "") for i in sorted(a.keys() - b.keys())]
    for i in sorted(a.keys() & b.keys()):
        for key in ("label", "alt", "comment", "confidence", "provenance"):
            if getattr(a[i], key) != getattr(b[i], key):
                out.append((i, "changed", key))
        for key in sorted({k for k, _ in a[i].extra} | {k for k, _ in b[i].extra}):
            if a[i].get(key) != b[i].get(key):
                out.append((i, "temporality" if key == "temporality" else "changed", key))
    return out


FRAGMENT = "datasource string, iri string, kind string, label string, alt array<string>, tier string, content string"


def fragments(spark: SparkSession, source: str, data: Dataset) -> DataFrame:
    """A row for each node, as the store keeps them."""
    rows = [(source, n.iri, n.kind, n.label, list(n.alt), t, json.dumps({"comment": n.comment, **dict(n.extra)}, sort_keys=True)) for t, ns in (("asserted", data.asserted), ("candidate", data.candidates)) for n in ns]
    return spark.createDataFrame(rows, FRAGMENT)


def upsert(spark: SparkSession, path: str, new: DataFrame, version: int) -> DataFrame:
    """Write version ``version`` of the store: ``new`` rows in place of those with their (datasource, iri), the others as they were."""
    target = f"{path}/v={version}"
    out = new
    if version > 0:
        old = spark.read.schema(FRAGMENT).parquet(f"{path}/v={version - 1}")
        out = old.join(new.select("datasource", "iri"), ["datasource", "iri"], "left_anti").select(*new.columns).unionByName(new)
    out.write.mode("overwrite").parquet(target)
    return spark.read.schema(FRAGMENT).parquet(target)


def record_run(spark: SparkSession, path: str, source: str, status: str, detail: str = "") -> None:
    """Append a row about a build; status is success, failed or partial."""
    if status not in ("success", "failed", "partial"):
        raise ValueError(status)
    spark.createDataFrame([(source, status, detail, datetime.now(UTC).isoformat())], "datasource string, status string, detail string, at string").write.mode("append").parquet(path)
