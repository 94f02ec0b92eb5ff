"""The engine's parts on small inputs; its queries against DuckDB."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import matching, text
from tessera.plans import anchor, grain, linker, ontology, planner
from tessera.plans.ir import Filter, Measure, Order, Request, RequestError
from tessera.plans.model import Column, Evidence, Join, Metric, Model
from tessera.sources.catalog import STAR


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in STAR:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(name, spark, sf, con):
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert a == b and a


def test_request_rules():
    for make in (
        lambda: Request(),
        lambda: Request(select=("t/a",), group_by=("t/a",)),
        lambda: Request(measures=(Measure(fn="SUM", property="t/a"),), distinct=True),
        lambda: Measure(),
        lambda: Measure(fn="MEDIAN", property="t/a"),
        lambda: Filter("t/a", "IN", "x"),
        lambda: Order(),
    ):
        with pytest.raises(RequestError):
            make()


def season_model():
    standing = Column("points", temporality="cumulative-snapshot", evidence=Evidence(("driver_id", "year"), "round"))
    return Model(
        {"results": [Column("driver_id"), Column("race_id"), Column("points")], "standings": [Column("driver_id"), Column("race_id"), standing], "drivers": [Column("id", key=True)], "races": [Column("race_id", key=True), Column("year"), Column("round")]},
        [Join("results", "drivers", (("driver_id", "id"),)), Join("standings", "drivers", (("driver_id", "id"),)), Join("standings", "races", (("race_id", "race_id"),))],
    )


def test_grain():
    m = season_model()
    res, sta = m.iri("results", "points"), m.iri("standings", "points")
    top = grain.resolve(Request(measures=(Measure(fn="MAX", property=res),)), m)
    assert top.shape == grain.LATEST and top.moved == ("results", "standings") and top.request.measures[0].property == sta
    total = grain.resolve(Request(measures=(Measure(fn="SUM", property=sta),)), m)
    assert total.shape == grain.EVENTS and total.moved == ("standings", "results")
    pinned = grain.resolve(Request(measures=(Measure(fn="MAX", property=res),), filters=(Filter(m.iri("races", "round"), "=", 9),)), m)
    assert pinned.shape == grain.ASOF and pinned.moved is None and pinned.ambiguous == [res]


def shop():
    status = Column("status", "text", "Status", ("open", "Closed", "São Paulo"), 3)
    return Model(
        {"orders": [Column("id", key=True), Column("total"), Column("placed_at", "temporal"), status], "customers": [Column("id", key=True), Column("name", "text"), Column("city", "text")]},
        [Join("orders", "customers", (("customer_id", "id"),))],
        [Metric("tsr:capability/turnover", "SUM(orders.total)", ("orders",), "Turnover")],
    )


def test_anchor_and_link():
    m = shop()
    index = anchor.build_index(m, {"customers": ["clients"]})
    found = anchor.anchor("show the clients of closed orders", index)
    assert set(found.terminals) == {"orders", "customers"}
    assert [(h.name, h.value) for h in found.of("value")] == [("status", "Closed")]
    assert anchor.anchor("custmers", index).terminals == ["customers"]
    request, notes = anchor.link("top 3 cities by turnover of sao paulo", m, index)
    assert request.measures[0].capability == "tsr:capability/turnover" and request.limit == 3 and not notes
    assert request.filters[0].value == "São Paulo" and request.group_by == (m.iri("customers", "city"),)
    assert anchor.link("what is love", m, index)[0] is None
    assert anchor.superlative("the latest orders", m, ["orders", "customers"]) == ("orders", "placed_at", "desc")
    assert anchor.superlative("the first and the last orders", m, ["orders"]) is None


def test_ontology(spark, tmp_path):
    m = shop()
    weak = Join("customers", "orders", (("name", "status"),), confidence=0.1, provenance="discovered")
    nodes = ontology.assemble(Model(m.classes, [*m.joins, weak], m.metrics))
    data = ontology.tier(nodes)
    assert len(data.candidates) == 1 and not ontology.validate(data.asserted, m)
    assert ontology.from_json(ontology.to_json(data)) == data
    back = ontology.load_model(data)
    assert [j.on for j in back.joins] == [j.on for j in m.joins] and back.metrics[0].formula == "SUM(orders.total)"
    bad = [*nodes, ontology.Node("tsr:capability/x", "metric", "X", extra=(("formula", "SUM(orders.nothing)"), ("tables", ("orders",))))]
    assert ("tsr:capability/x", "unknown column orders.nothing") in ontology.validate(bad, m)
    with pytest.raises(ValueError):
        ontology.dedupe([nodes[0], ontology.Node(nodes[0].iri, "class", "Other")])
    assert "owl:ObjectProperty" in ontology.to_turtle(nodes) and "candidates>" in ontology.to_trig(data) and "orders" in ontology.to_mermaid(m)
    changed = [ontology.Node(n.iri, n.kind, "Renamed" if n.kind == "metric" else n.label, n.alt, n.comment, n.confidence, n.provenance, n.extra) for n in nodes]
    assert ontology.diff(nodes, changed[:-1] + changed[-1:]) == [("tsr:capability/turnover", "changed", "label")]
    path = str(tmp_path / "store")
    ontology.upsert(spark, path, ontology.fragments(spark, "a", data), 0)
    after = ontology.upsert(spark, path, ontology.fragments(spark, "a", ontology.Dataset([changed[-1]])), 1)
    assert after.count() == len(nodes) and after.where("label = 'Renamed'").count() == 1
    pruned = ontology.prune_alt_labels([ontology.Node("a", "class", "One", ("two", "uno")), ontology.Node("b", "class", "Two")])
    assert pruned[0].alt == ("uno",)


def test_revenue_and_labels():
    m = Model({"orders": [Column("total_amount")], "refunds": [Column("amount")]})
    assert ontology.add_revenue(m).metrics[0].formula == "SUM(orders.total_amount) - COALESCE(SUM(refunds.amount), 0)"
    assert ontology.humanize("createdAt_utc") == "Created at utc" and ontology.predicate("home_team_id") == "homeTeam"
    assert ontology.header("db://user:secret@host:1/x", {}) ["source"] == ontology.header("db://host:1/x", {})["source"]


def test_directions():
    assert text.direction("best") == "desc" and text.direction("best", "lower") == "asc" and text.direction("slowest", "lower") == "desc"
    assert text.number_word("seven") == 7 and text.number_word("12") == 12 and text.number_word("x") is None


def test_ordered_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert matching.match_ordered(a, a, ["a"]) and not matching.match_ordered(a, spark.createDataFrame([(1, "y"), (2, "x")], "a int, b string"), ["a"])


def test_metric_dry_run(spark):
    m = shop()
    tables = {"orders": spark.createDataFrame([(1, 2.0, "open")], "id int, total double, status string")}
    assert ontology.dry_run(m.metrics[0], m, tables) == []
    assert ontology.dry_run(Metric("x", "SUM(orders.nope)", ("orders",)), m, tables)
    assert "needs a number" in ontology.dry_run(Metric("x", "MAX(orders.status)", ("orders",), unit="EUR"), m, tables)[0]


def test_ground_request():
    m = shop()
    got, notes = planner.ground_request(Request(select=(m.iri("orders", "total"), m.iri("orders", "nope"))), m)
    assert got.select == (m.iri("orders", "total"),) and len(notes) == 1
    assert planner.ground_request(Request(select=("x/y",)), m)[0] is None
    request, _ = anchor.link("average total by status", m, anchor.build_index(m))
    assert request.measures[0].fn == "AVG" and request.group_by == (m.iri("orders", "status"),)


def test_linker_passes():
    m = queries._question_model()
    got = linker.link_question("order value per priority for building", m)
    assert [t.element for t in got.measures] == [("orders", "o_totalprice")] and got.dimensions == [("orders", "o_orderpriority")] and got.filters == {("customer", "c_mktsegment"): ["BUILDING"]}
    ranked = linker.link_question("the lowest order value", m)
    assert ranked.limit == 1 and not ranked.order[1] and not ranked.measures
    m.column("nation", "n_name").samples = ("ASIA", "PERU")
    both = linker.link_question("names in asia of zzyzx", m)
    assert both.ambiguous[0][0] == "asia" and len(both.ambiguous[0][1]) == 2 and both.unresolved == ["zzyzx"]
    assert any("zzyzx" in w for w in linker.warnings(both, m)) and any("ambiguous" in w for w in linker.warnings(both, m))
    keyed = linker.link_question("show custkey of orders", m)
    assert not keyed.projection  # keys and linking columns are never shown
    m.column("orders", "o_totalprice").temporality = "cumulative-snapshot"
    m.metrics = []
    total = linker.Intent(tables=["orders"], measures=[linker.Target("measure", "orders", "o_totalprice")])
    assert linker.to_request(total, m).measures[0].fn == "MAX" and "running total" in " ".join(linker.warnings(total, m))
    with pytest.raises(ValueError):
        linker.answer("qwerty", m, {})


def test_trim_keeps_joins_and_what_was_named():
    m = queries._question_model()
    found = anchor.anchor("order value per priority for building customers", anchor.build_index(m))
    anchored = linker.anchored_columns(found)
    assert "c_mktsegment" in anchored["customer"]
    small = linker.trim(m, ["customer"], anchored)
    assert {c.name for c in small.classes["nation"]} <= {"n_nationkey", "n_regionkey", "n_name"} and small.column("customer", "c_mktsegment").samples
    assert small.column("customer", "c_acctbal") is None


def test_run_sql_leaves_no_views(spark):
    from tessera.sources.catalog import Catalog, run_sql

    spark.range(3).createOrReplaceTempView("rs_kept")
    c = Catalog(spark, {"rs_kept": spark.range(5), "rs_own": spark.range(7)})
    assert run_sql(c, "SELECT count(*) AS n FROM rs_kept, rs_own WHERE rs_own.id < ?", [2]).collect()[0]["n"] == 10
    assert spark.table("rs_kept").count() == 3 and not spark.catalog.tableExists("rs_own")


def test_composite_keys_of_wide_tables(spark):
    """More pairs than any batch holds: the one key among 30 columns is found."""
    from tessera.operators import profile
    from tessera.sources.catalog import Catalog

    wide = spark.range(400).select(*[((F.col("id") * (i + 3)) % 20).alias(f"c{i:02}") for i in range(28)], (F.col("id") % 20).alias("y"), F.floor(F.col("id") / 20).cast("int").alias("z"))
    c = Catalog(spark, {"wide": wide})
    found = [tuple(r["columns"]) for r in profile.composite_keys(c, "wide", profile.profile_table(c, "wide").collect()).collect()]
    assert ("y", "z") in found


def test_soft_scores_agree_with_the_plain_version(spark):
    cases = [([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]), ([(1, "a")], []), ([(1, None), (1, None)], [(1, None)]), ([(2, "x"), (1, "y")], [(1, "y"), (2, "x")])]
    for gold, found in cases:
        a, b = (spark.createDataFrame(x, "a int, b string") for x in (gold, found))
        assert abs(matching.soft_scores(a.coalesce(1), b.coalesce(1), ordered=True).collect()[0]["f1"] - matching.soft_f1(gold, found)) < 1e-9
    a, b = (spark.createDataFrame(x, "a int, b string") for x in cases[3])
    assert matching.soft_scores(a, b).collect()[0]["f1"] == 1.0 and not matching.match_in_place(a.coalesce(1), b.coalesce(1))


def test_steps_equal_sql_where_sums_are_exact(spark, sf, tmp_path):
    """Whole numbers add up alike in any order: days that tie, days of 0 and falls are counted as in SQL, however the rows lie."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(40), rng.randrange(20), rng.choice(["view", "purchase"]), float(rng.randrange(5))) for i in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, day int, event_type string, value double")
    events = events.select("event_id", F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval(day)").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    counts = []
    for n, d in enumerate((events.coalesce(1), events.orderBy(F.desc("event_id")).coalesce(1), events.repartition(7, "event_type", "value"))):
        folder = tmp_path / str(n)
        folder.mkdir()
        for t in STAR:
            if t != "events":
                (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        d.write.parquet(f"{folder}/events.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        want = sorted(c.sql(queries.oracle_sql()["temporal_monotonic"]).fetchall())
        assert sorted(map(tuple, queries.queries()["temporal_monotonic"](spark, str(folder)).collect())) == want
        ties = c.sql(queries.cte("ev_daily") + "SELECT count(*) FROM (SELECT amount - lag(amount) OVER (PARTITION BY user_id ORDER BY d) AS dd FROM ev_daily) WHERE dd = 0").fetchall()
        assert ties[0][0] > 20
        counts.append(want)
    assert counts[0] == counts[1] == counts[2]


def test_build_and_harness(spark, tmp_path):
    from tessera.operators import harness
    from tessera.plans import build
    from tessera.sources.catalog import Catalog, ForeignKey, Key

    users = spark.createDataFrame([(i, f"u{i}") for i in range(4)], "id int, name string")
    cal = spark.createDataFrame([(d, 2020, d) for d in range(12)], "day int, season_year int, round int")
    rows = [(u, d, 5 * (d // 2), d % 3, "ab"[d % 2]) for u in range(4) for d in range(12)]
    scores = spark.createDataFrame(rows, "user_id int, day int, points int, goals int, side string")
    c = Catalog(spark, {"users": users, "cal": cal, "scores": scores}, [Key("users", ("id",)), Key("cal", ("day",))], [ForeignKey("scores", "user_id", "users", "id")])
    b = build.build(c)
    assert b.status == "success" and not b.failures
    assert b.model.column("scores", "points").temporality == "cumulative-snapshot" and b.model.column("scores", "goals").temporality == ""
    assert b.model.column("scores", "side").samples == ("a", "b") and any(j.target == "users" and j.confidence == 1 for j in b.model.joins)
    again = build.build(c, freeze=[ontology.Node("tsr:class/users", "class", "People", ("members",))])
    assert next(n for n in again.data.asserted if n.iri == "tsr:class/users").label == "People"
    noted = ontology.Node("p", "property", "P", comment="points of a race", extra=(("temporality", "cumulative-snapshot"),))
    assert build.warnings([noted]) and not build.warnings([ontology.Node("p", "property", "P", comment="running points", extra=noted.extra)])

    users.createOrReplaceTempView("h_users")
    items = [harness.Item("1", "q", "SELECT name FROM h_users", "x"), harness.Item("2", "q", "SELECT count(*) FROM h_users", "x"), harness.Item("3", "q", "SELECT nope FROM h_users", "y")]
    log = tmp_path / "log.jsonl"
    got = harness.run_system(spark, items, lambda q: ("SELECT name FROM h_users", 10), log)
    assert [r.strict for r in got] == [True, False, False] and "nope" in got[2].error
    with pytest.raises(FileExistsError):
        harness.run_system(spark, items, lambda q: ("", 0), log)
    s = matching.summarize(harness.load_log(spark, str(log))).collect()[0]
    assert (s["n"], s["strict"], s["tokens_per_correct"]) == (3, 1, 20.0)


def test_command_line(spark, sf, tmp_path, capsys):
    from tessera.__main__ import main

    assert main(["link", sf, "order value by priority"]) == 0 and "o_orderpriority" in capsys.readouterr().out
    assert main(["link", sf, "zzyzx"]) == 1
    assert main(["joinpath", "--tables", "region,orders", "--min-confidence", "0.5"]) == 0
    assert main(["profile", sf, "--stage", "single"]) == 0
    for version in (0, 1):
        assert main(["generate", sf, "--out", str(tmp_path), "--tables", "region,nation,customer"]) == 0
        assert spark.read.parquet(str(tmp_path / "store" / f"v={version}")).where("kind = 'class'").count() == 3
    assert "success" in capsys.readouterr().out and (tmp_path / "ontology.trig").read_text() and spark.read.parquet(str(tmp_path / "runs")).count() == 2
