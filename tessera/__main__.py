"""Command line over a folder of the star schema: generate, profile, joinpath, link, ask, export."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import queries
from .operators import inclusion, profile
from .plans import build, linker, ontology, planner, routing
from .plans.evidence import parse_evidence
from .plans.ir import RequestError
from .sources.catalog import STAR


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("generate", "profile", "link", "ask"):
        sub.add_parser(name).add_argument("folder")
    sub.choices["generate"].add_argument("--out", required=True, help="folder for the graph's files and its store")
    sub.choices["generate"].add_argument("--tables", default=",".join(STAR), help="names with commas")
    sub.choices["profile"].add_argument("--stage", choices=["columns", "single", "keys", "pairs", "fks"], default="columns")
    sub.choices["link"].add_argument("question")
    sub.choices["link"].add_argument("--evidence", default="")
    sub.choices["ask"].add_argument("question", nargs="?", help="left out: questions are read line by line")
    path = sub.add_parser("joinpath")
    path.add_argument("--tables", required=True, help="names with commas")
    path.add_argument("--paths", type=int, default=0)
    path.add_argument("--min-confidence", type=float, default=0.0)
    sub.add_parser("export").add_argument("--format", choices=["json", "turtle", "trig", "mermaid"], default="json")
    return top


def _generate(spark: SparkSession, folder: str, out: str, tables: list[str]) -> int:
    """Build the ontology, write its files and its store; 1 if a part of it failed."""
    made = build.build(queries.star(spark, folder).only(tables))
    target = Path(out)
    target.mkdir(parents=True, exist_ok=True)
    (target / "ontology.json").write_text(ontology.to_json(made.data, ontology.header(folder, {"tables": tables})))
    (target / "ontology.trig").write_text(ontology.to_trig(made.data))
    versions = [int(p.name[2:]) for p in (target / "store").glob("v=*")]
    ontology.upsert(spark, str(target / "store"), ontology.fragments(spark, folder, made.data), max(versions, default=-1) + 1)
    ontology.record_run(spark, str(target / "runs"), folder, made.status, "; ".join([*(f"{i}: {e}" for i, e in made.problems), *made.failures]))
    for line in [*made.warnings, *(f"{i}: {e}" for i, e in made.problems), *made.failures]:
        print(line, file=sys.stderr)
    print(f"{made.status}: {len(made.data.asserted)} asserted, {len(made.data.candidates)} candidates")
    return int(made.status != "success")


def _profile(catalog, stage: str) -> None:
    spark, profiles = catalog.spark, profile.profile(catalog)
    if stage == "columns":
        profiles.show(200, truncate=40)
    elif stage == "single":
        profile.single_keys(profiles).show(200, truncate=60)
    else:
        rows = profiles.collect()  # a row for each column of the schema
        singles = [(r["table_name"], r["column_name"]) for r in rows if r["num_rows"] and r["uniqueness_ratio"] == 1]
        if stage == "keys":
            for t in sorted(catalog.tables):
                profile.composite_keys(catalog, t, [r for r in rows if r["table_name"] == t]).show(200, truncate=60)
            return
        pairs = inclusion.prefilter(rows, singles)
        if stage == "pairs":
            spark.createDataFrame([(x.source, x.column, x.target, x.target_column, r) for x, r in pairs], "source string, column string, target string, target_column string, reason string").show(1000, truncate=40)
            return
        found = inclusion.containment(catalog, [x for x, r in pairs if not r]).collect()  # a row for each pair of the schema
        for x in sorted(inclusion.foreign_keys(catalog, rows, singles, found), key=lambda x: -x.score):
            print(f"{x.score:.3f} {x.source}.{x.column} -> {x.target}.{x.target_column} {x.kind} {x.cardinality} {x.evidence} {x.containment:.3f}")


def _ask(question: str, model, tables) -> int:
    try:
        answer = planner.ask(question, model, tables)
    except RequestError as e:
        print(f"{e.code}: {e}")
        return 1
    if answer.frame is None:
        print(f"{answer.failed}: {answer.message}")
        return 1
    print(answer.sql)
    answer.frame.show(50, truncate=60)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    model = queries.star_model(tuple(t for t in STAR if t != "events"))
    if args.command == "joinpath":
        names, joins = args.tables.split(","), [j for j in model.joins if j.confidence >= args.min_confidence]
        found = routing.best_paths(joins, names[0], names[-1], args.paths) if args.paths else [routing.join_path(joins, names)]
        print(json.dumps([{"tables": p.tables, "joins": [j.name for j in p.joins], "score": p.score, "fan_out": p.fan_out} for p in found if p], indent=1))
        return 0
    if args.command == "export":
        data = ontology.tier(ontology.assemble(model))
        print({"json": lambda: ontology.to_json(data), "turtle": lambda: ontology.to_turtle(data.asserted), "trig": lambda: ontology.to_trig(data), "mermaid": lambda: ontology.to_mermaid(model)}[args.format]())
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "generate":
        return _generate(spark, args.folder, args.out, args.tables.split(","))
    catalog = queries.star(spark, args.folder)
    if args.command == "profile":
        _profile(catalog, args.stage)
        return 0
    if args.command == "link":
        try:
            got = linker.answer(args.question, model, catalog.tables, hints=parse_evidence(args.evidence, model) if args.evidence else None)
        except (RequestError, ValueError) as e:
            print(e)
            return 1
        print(got.sql)
        for w in got.warnings:
            print(f"-- {w}")
        got.frame.show(50, truncate=60)
        return 0
    if args.question:
        return _ask(args.question, model, catalog.tables)
    for line in sys.stdin:
        if line.strip() in ("exit", "quit"):
            break
        if line.strip():
            _ask(line.strip(), model, catalog.tables)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
