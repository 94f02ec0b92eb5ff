"""The engine's queries by name, and the same in SQL.

Where an operator has no SQL form (graph search, words) its result table is
compared with values worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import matching, text
from .operators import facts, inclusion, profile, temporality
from .plans import anchor, build, compiler, grain, linker, ontology, planner, routing
from .plans.evidence import grounding_slice, parse_evidence
from .plans.ir import Filter, Measure, Order, Request, RequestError, leash
from .plans.model import Column, Evidence, Join, Metric, Model
from .sources.catalog import STAR, Catalog, ForeignKey, Key, open_star

#: Columns of the star schema by family, for the SQL side (n number, t text, d time).
COLUMNS = {
    "region": "r_regionkey:n r_name:t",
    "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:d o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:t value:n props:t",
}
COLS = {t: [tuple(c.split(":")) for c in v.split()] for t, v in COLUMNS.items()}
KINDS = {"n": "numeric", "t": "text", "d": "temporal"}

#: Views with cases that the tables lack, the same text for both engines but for the JSON function.
VIEWS = {
    "ev_daily": "SELECT user_id, CAST(ts AS DATE) AS d, SUM(value) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "cal": "SELECT DISTINCT CAST(ts AS DATE) AS d, CAST(year(ts) AS INT) AS season_year, CAST(dayofyear(ts) AS INT) AS round FROM events",
    "standings": "SELECT user_id, d, SUM(amount) OVER (PARTITION BY user_id, year(d) ORDER BY d) AS points FROM (SELECT user_id, CAST(ts AS DATE) AS d, SUM(value) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)) e",
    "balance": "SELECT user_id, d, SUM(amount) OVER (PARTITION BY user_id ORDER BY d) AS points FROM (SELECT user_id, CAST(ts AS DATE) AS d, SUM(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)) e",
    "users": "SELECT DISTINCT user_id FROM events",
    "bridge": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "with_nulls": "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "placeholder": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'N/A' ELSE p_type END AS p_type FROM part",
    "line_a": "SELECT l_orderkey, l_suppkey, SUM(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_suppkey",
    "line_b": "SELECT l_orderkey, l_suppkey, SUM(l_extendedprice) AS price FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_suppkey",
}
EV_K = {"spark": "SELECT event_id, user_id, event_type, value, get_json_object(props, '$.k') AS k FROM events", "duckdb": "SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events"}


def star(spark: SparkSession, folder: str, views: tuple[str, ...] = ()) -> Catalog:
    c = open_star(spark, folder)
    for t, d in c.tables.items():
        d.createOrReplaceTempView(t)
    for v in views:
        c.tables[v] = spark.sql(EV_K["spark"] if v == "ev_k" else VIEWS[v])
    return c


def cte(*views: str) -> str:
    return "WITH " + ", ".join(f"{v} AS ({EV_K['duckdb'] if v == 'ev_k' else VIEWS[v]})" for v in views) + " "


STAR_JOINS = [
    Join("nation", "region", (("n_regionkey", "r_regionkey"),)), Join("customer", "nation", (("c_nationkey", "n_nationkey"),)),
    Join("supplier", "nation", (("s_nationkey", "n_nationkey"),)), Join("orders", "customer", (("o_custkey", "c_custkey"),)),
    Join("lineitem", "orders", (("l_orderkey", "o_orderkey"),)), Join("lineitem", "part", (("l_partkey", "p_partkey"),)),
    Join("lineitem", "supplier", (("l_suppkey", "s_suppkey"),)),
]
METRICS = [
    Metric("tsr:capability/order-value", "SUM(orders.o_totalprice)", ("orders",), "Order value"),
    Metric("tsr:capability/revenue", "SUM(lineitem.l_extendedprice * (1 - lineitem.l_discount))", ("lineitem",), "Revenue"),
]
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def star_model(tables: tuple[str, ...]) -> Model:
    """The part of the star that a question was found to need, pruned to what connects it."""
    key = {"r_regionkey", "n_nationkey", "c_custkey", "s_suppkey", "p_partkey", "o_orderkey", "event_id"}
    classes = {t: [Column(c, KINDS[k], key=c in key) for c, k in COLS[t]] for t in tables}
    m = Model(classes, [j for j in STAR_JOINS if {j.source, j.target} <= set(tables)], METRICS)
    if "region" in classes:
        r = m.column("region", "r_name")
        r.samples, r.distinct = REGIONS, len(REGIONS)
    return m


def p(table: str, column: str) -> str:
    return f"tsr:property/{table}/{column}"


def _request(tables: tuple[str, ...], request: Request, rounded: tuple[str, ...] = (), views: tuple[str, ...] = (), model: Model | None = None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = star(spark, folder, views)
        out = compiler.compile_request(request, model or star_model(tables), c.tables).frame
        return out.withColumns({r: F.round(r, 2) for r in rounded}) if rounded else out

    return run


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = run
    if sql:
        SQL[name] = sql


# ------------------------------------------------------------------ requests

add(
    "ir_agg_capability_join",
    _request(("orders", "customer", "nation", "region"), Request(measures=(Measure(capability=METRICS[0].iri, alias="order_value"),), group_by=(p("nation", "n_name"),), filters=(Filter(p("region", "r_name"), "=", "ASIA"),)), ("order_value",)),
    "SELECT n_name, ROUND(SUM(o_totalprice), 2) AS order_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
)
add("ir_projection", _request(("nation", "region"), Request(select=(p("nation", "n_name"), p("region", "r_name")))), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("ir_projection_distinct", _request(("customer", "nation"), Request(select=(p("nation", "n_name"), p("customer", "c_mktsegment")), distinct=True)), "SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
add(
    "ir_ranking_topk",
    _request(("orders",), Request(select=(p("orders", "o_orderkey"), p("orders", "o_totalprice")), order_by=(Order(property=p("orders", "o_totalprice"), descending=True), Order(property=p("orders", "o_orderkey"))), limit=25)),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
_nulls = Model({"with_nulls": [Column("o_orderkey", key=True), Column("o_totalprice"), Column("o_orderpriority", "text")]})
for _end in ("FIRST", "LAST"):
    add(
        f"ir_ranking_nulls_{_end.lower()}",
        _request((), Request(select=(p("with_nulls", "o_orderkey"), p("with_nulls", "o_orderpriority")), order_by=(Order(property=p("with_nulls", "o_orderpriority"), nulls=_end), Order(property=p("with_nulls", "o_orderkey"))), limit=500), views=("with_nulls",), model=_nulls),
        cte("with_nulls") + f"SELECT o_orderkey, o_orderpriority FROM with_nulls ORDER BY o_orderpriority NULLS {_end}, o_orderkey LIMIT 500",
    )
add("ir_agg_count", _request(("orders",), Request(measures=(Measure(fn="COUNT", property=p("orders", "o_orderkey"), alias="n"),), group_by=(p("orders", "o_orderstatus"),))), "SELECT o_orderstatus, COUNT(o_orderkey) AS n FROM orders GROUP BY 1")
add("ir_agg_sum", _request(("lineitem",), Request(measures=(Measure(fn="SUM", property=p("lineitem", "l_quantity")),), group_by=(p("lineitem", "l_returnflag"),)), ("sum_l_quantity",)), "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1")
add("ir_agg_avg", _request(("part",), Request(measures=(Measure(fn="AVG", property=p("part", "p_retailprice")),), group_by=(p("part", "p_brand"),)), ("avg_p_retailprice",)), "SELECT p_brand, ROUND(AVG(p_retailprice), 2) AS avg_p_retailprice FROM part GROUP BY 1")
add(
    "ir_agg_min_max",
    _request(("orders",), Request(measures=(Measure(fn="MIN", property=p("orders", "o_totalprice")), Measure(fn="MAX", property=p("orders", "o_totalprice"))), group_by=(p("orders", "o_orderpriority"),))),
    "SELECT o_orderpriority, MIN(o_totalprice) AS min_o_totalprice, MAX(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1",
)
add(
    "ir_group_multi",
    _request(("lineitem",), Request(measures=(Measure(capability=METRICS[1].iri, alias="revenue"),), group_by=(p("lineitem", "l_returnflag"), p("lineitem", "l_linestatus"))), ("revenue",)),
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2",
)
_filters = {
    "eq": (Filter(p("customer", "c_mktsegment"), "=", "BUILDING"), "c_mktsegment = 'BUILDING'"),
    "ne": (Filter(p("customer", "c_mktsegment"), "!=", "BUILDING"), "c_mktsegment <> 'BUILDING'"),
    "range": (Filter(p("customer", "c_acctbal"), ">=", 5000), "c_acctbal >= 5000"),
    "in": (Filter(p("customer", "c_nationkey"), "IN", ("1", "2", "3")), "c_nationkey IN (1, 2, 3)"),
    "like": (Filter(p("customer", "c_name"), "LIKE", "%00%"), "c_name LIKE '%00%'"),
}
for _name, (_f, _w) in _filters.items():
    add(f"ir_filter_{_name}", _request(("customer",), Request(select=(p("customer", "c_custkey"), p("customer", "c_acctbal")), filters=(_f,))), f"SELECT c_custkey, c_acctbal FROM customer WHERE {_w}")
add(
    "ir_order_by_alias",
    _request(("orders", "customer", "nation"), Request(measures=(Measure(fn="COUNT", property=p("orders", "o_orderkey"), alias="n"),), group_by=(p("nation", "n_name"),), order_by=(Order(alias="n", descending=True), Order(property=p("nation", "n_name"))), limit=7)),
    "SELECT n_name, COUNT(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 7",
)
add(
    "ir_backprune",  # lineitem, part and supplier are in scope; joining them would multiply orders
    _request(("orders", "lineitem", "part", "supplier", "customer"), Request(measures=(Measure(fn="SUM", property=p("orders", "o_totalprice"), alias="total"), Measure(fn="COUNT", property=p("orders", "o_orderkey"), alias="n")), group_by=(p("customer", "c_mktsegment"),)), ("total",)),
    "SELECT c_mktsegment, ROUND(SUM(o_totalprice), 2) AS total, COUNT(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
_evk = Model({"ev_k": [Column("event_id", key=True), Column("user_id"), Column("event_type", "text"), Column("value"), Column("k", "text", numeric_text=True)]})
add(
    "ir_numeric_text_cast",
    _request((), Request(measures=(Measure(fn="SUM", property=p("ev_k", "k"), alias="total"), Measure(fn="MAX", property=p("ev_k", "k"), alias="top")), group_by=(p("ev_k", "event_type"),), filters=(Filter(p("ev_k", "k"), ">", 7),)), views=("ev_k",), model=_evk),
    cte("ev_k") + "SELECT event_type, SUM(CAST(k AS DOUBLE)) AS total, MAX(CAST(k AS DOUBLE)) AS top FROM ev_k WHERE CAST(k AS DOUBLE) > 7 GROUP BY 1",
)
_lines = Model({t: [Column("l_orderkey"), Column("l_suppkey"), Column(v)] for t, v in (("line_a", "qty"), ("line_b", "price"))}, [Join("line_a", "line_b", (("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey")), "many-to-many", 0.75, "co-reference")])
add(
    "ir_composite_join",
    _request((), Request(select=(p("line_a", "l_orderkey"), p("line_a", "l_suppkey"), p("line_a", "qty"), p("line_b", "price"))), ("price",), ("line_a", "line_b"), _lines),
    cte("line_a", "line_b") + "SELECT a.l_orderkey, a.l_suppkey, a.qty, ROUND(b.price, 2) AS price FROM line_a a JOIN line_b b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey",
)
_local = Model({"standings": [Column("user_id"), Column("d", "temporal"), Column("points", temporality="cumulative-snapshot", evidence=Evidence(("user_id",), "d"))]})
add(
    "ir_decumulate_local",
    _request((), Request(measures=(Measure(fn="SUM", property=p("standings", "points"), alias="total"), Measure(fn="COUNT", property=p("standings", "user_id"), alias="n"))), ("total",), ("standings",), _local),
    cte("standings") + "SELECT ROUND(SUM(points), 2) AS total, COUNT(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY d DESC) rn FROM standings) x WHERE rn = 1",
)
_season = Model(
    {"standings": [Column("user_id"), Column("d", "temporal"), Column("points", temporality="cumulative-snapshot", evidence=Evidence(("user_id", "season_year"), "round"))], "cal": [Column("d", "temporal", key=True), Column("season_year"), Column("round")]},
    [Join("standings", "cal", (("d", "d"),))],
)
add(
    "ir_decumulate_calendar",
    _request((), Request(measures=(Measure(fn="SUM", property=p("standings", "points"), alias="total"),), group_by=(p("cal", "season_year"),)), ("total",), ("standings", "cal"), _season),
    cte("standings", "cal") + "SELECT season_year, ROUND(SUM(points), 2) AS total FROM (SELECT s.*, c.season_year, ROW_NUMBER() OVER (PARTITION BY user_id, season_year ORDER BY round DESC) rn FROM standings s JOIN cal c ON s.d = c.d) x WHERE rn = 1 GROUP BY 1",
)


def _leash(spark: SparkSession, folder: str) -> DataFrame:
    m = star_model(("nation", "region"))
    cases = [
        ("exact", Filter(p("region", "r_name"), "=", "ASIA")), ("normalized", Filter(p("region", "r_name"), "=", "middle-east")),
        ("unknown value", Filter(p("region", "r_name"), "=", "Atlantis")), ("unknown column", Filter(p("region", "r_size"), "=", "x")),
        ("free text", Filter(p("nation", "n_name"), "=", "Nowhere")), ("list", Filter(p("region", "r_name"), "IN", ("asia", "Europe"))),
    ]
    rows = []
    for name, f in cases:
        c = leash(Request(select=(p("nation", "n_name"),), filters=(f,)), m)
        v = c.request.filters[0].value
        rows.append((name, len(c.issues), "|".join(v) if isinstance(v, tuple) else v))
    return spark.createDataFrame(rows, "case_name string, issues int, value string")


add("ir_leash", _leash, "SELECT * FROM (VALUES ('exact', 0, 'ASIA'), ('normalized', 0, 'MIDDLE EAST'), ('unknown value', 1, 'Atlantis'), ('unknown column', 1, 'x'), ('free text', 0, 'Nowhere'), ('list', 0, 'ASIA|EUROPE')) t(case_name, issues, value)")


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    c, m = star(spark, folder), star_model(("orders", "part"))
    cases = {
        "table": lambda: Request(select=(p("region", "r_name"),)), "column": lambda: Request(select=(p("orders", "x"),)),
        "capability": lambda: Request(measures=(Measure(capability="tsr:capability/none"),)), "unreachable": lambda: Request(select=(p("orders", "o_orderkey"), p("part", "p_name"))),
        "shape": lambda: Request(select=(p("orders", "o_orderkey"),), measures=(Measure(fn="SUM", property=p("orders", "o_totalprice")),)),
        "distinct order": lambda: Request(select=(p("orders", "o_orderstatus"),), distinct=True, order_by=(Order(property=p("orders", "o_orderkey")),)),
        "literal": lambda: Request(select=(p("orders", "o_orderkey"),), filters=(Filter(p("orders", "o_custkey"), "=", "abc"),)),
    }
    rows = []
    for name, make in cases.items():
        try:
            compiler.compile_request(make(), m, c.tables)
            rows.append((name, "none"))
        except RequestError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "case_name string, code string")


add("ir_errors", _errors, "SELECT * FROM (VALUES ('table', 'scope-table'), ('column', 'scope-column'), ('capability', 'scope-capability'), ('unreachable', 'unreachable'), ('shape', 'shape'), ('distinct order', 'distinct-order'), ('literal', 'filter-type')) t(case_name, code)")

# ------------------------------------------------------------------ profiling


def _profile_sql(tables=STAR) -> str:
    out = []
    for t in tables:
        for c, k in COLS[t]:
            lo, hi = (f"min({c})", f"max({c})")
            num = f"CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), NULL, NULL" if k == "n" else f"epoch({lo}), epoch({hi}), NULL, NULL" if k == "d" else f"NULL, NULL, {lo}, {hi}"
            out.append(f"SELECT '{t}', '{c}', '{KINDS[k]}', count(*), count(*) - count({c}), count(DISTINCT {c}), {num} FROM {t}")
    return "p(table_name, column_name, family, num_rows, null_count, distinct_count, min_num, max_num, min_text, max_text) AS MATERIALIZED (" + " UNION ALL ".join(out) + ")"


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    d = profile.profile(star(spark, folder))
    return d.select("table_name", "column_name", "family", "num_rows", "null_count", "null_ratio", "distinct_count", F.round("uniqueness_ratio", 9).alias("uniqueness_ratio"), *[F.round(c, 3).alias(c) for c in ("min_num", "max_num")], "min_text", "max_text")


add("profile_columns", _profiles, "WITH " + _profile_sql() + " SELECT table_name, column_name, family, num_rows, null_count, null_count / num_rows AS null_ratio, distinct_count, ROUND(distinct_count / num_rows, 9) AS uniqueness_ratio, ROUND(min_num, 3) AS min_num, ROUND(max_num, 3) AS max_num, min_text, max_text FROM p")


def _with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_table(star(spark, folder, ("with_nulls",)), "with_nulls").select("column_name", "num_rows", "null_count", F.round("null_ratio", 9).alias("null_ratio"), F.round("uniqueness_ratio", 9).alias("uniqueness_ratio"))


add("profile_ratios", _with_nulls, cte("with_nulls") + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS num_rows, count(*) - count({c}) AS null_count, ROUND((count(*) - count({c})) / count(*), 9) AS null_ratio, ROUND(count(DISTINCT {c}) / count(*), 9) AS uniqueness_ratio FROM with_nulls" for c in ("o_orderkey", "o_totalprice", "o_orderpriority")))


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder).numeric_stats("lineitem").select("column_name", *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "avg_value")])


add("profile_numeric_stats", _stats, " UNION ALL ".join(f"SELECT '{c}' AS column_name, ROUND(CAST(min({c}) AS DOUBLE), 4) AS min_value, ROUND(CAST(max({c}) AS DOUBLE), 4) AS max_value, ROUND(avg(CAST({c} AS DOUBLE)), 4) AS avg_value FROM lineitem" for c, k in COLS["lineitem"] if k == "n"))
add("source_sample", lambda s, d: star(s, d).sample("orders", ["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
add(
    "source_schema",
    lambda s, d: s.createDataFrame([(c.table, c.name, c.position, c.family) for c in star(s, d).all_columns()], "table_name string, column_name string, position int, family string"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {i}, '{KINDS[k]}')" for t in STAR for i, (c, k) in enumerate(COLS[t])) + ") t(table_name, column_name, position, family)",
)


def _single(spark: SparkSession, folder: str) -> DataFrame:
    return profile.single_keys(profile.profile(star(spark, folder))).select("table_name", F.col("columns")[0].alias("column_name"), "certain")


add("keys_single", _single, "WITH " + _profile_sql() + " SELECT table_name, column_name, null_count = 0 AS certain FROM p WHERE num_rows > 0 AND distinct_count = num_rows")


def _composite(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder, ("bridge", "line_a"))
    out = None
    for t in ("bridge", "line_a"):
        d = profile.composite_keys(c, t, profile.profile_table(c, t).collect()).select("table_name", F.col("columns")[0].alias("a"), F.col("columns")[1].alias("b"))
        out = d if out is None else out.unionByName(d)
    return out


def _composite_sql() -> str:
    parts = []
    for t, cols in (("bridge", ["l_partkey", "l_suppkey"]), ("line_a", ["l_orderkey", "l_suppkey", "qty"])):
        for i, a in enumerate(cols):
            for b in cols[i + 1 :]:
                parts.append(f"SELECT '{t}' AS table_name, '{a}' AS a, '{b}' AS b WHERE (SELECT count(*) = count(DISTINCT ({a}, {b})) AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*) FROM {t})")
    return cte("bridge", "line_a") + " UNION ALL ".join(parts)


add("keys_composite", _composite, _composite_sql())


def _union(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder).only(["orders", "lineitem", "nation"])
    found = profile.single_keys(profile.profile(c))
    declared = [*c.keys, Key("lineitem", ("l_linenumber", "l_orderkey"), True)]
    return profile.key_union(c, found, declared).select("table_name", F.concat_ws("+", "columns").alias("columns"), "declared", "method", "certain")


add(
    "keys_declared_union", _union,
    "WITH " + _profile_sql(["orders", "lineitem", "nation"]) + ", d(t, c) AS (VALUES ('orders', 'o_orderkey'), ('nation', 'n_nationkey'), ('lineitem', 'l_linenumber+l_orderkey')), f AS (SELECT table_name, column_name FROM p WHERE num_rows > 0 AND distinct_count = num_rows) "
    "SELECT coalesce(table_name, t) AS table_name, coalesce(column_name, c) AS columns, CASE WHEN t IS NOT NULL THEN 'primary' END AS declared, CASE WHEN table_name IS NULL THEN 'declared' ELSE 'discovered' END AS method, TRUE AS certain FROM f FULL JOIN d ON table_name = t AND column_name = c",
)

PRIMARY = [(k.table, k.columns[0]) for k in (Key("region", ("r_regionkey",)), Key("nation", ("n_nationkey",)), Key("customer", ("c_custkey",)), Key("supplier", ("s_suppkey",)), Key("part", ("p_partkey",)), Key("orders", ("o_orderkey",)), Key("events", ("event_id",)))]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.profile(star(spark, folder)).collect()
    return spark.createDataFrame([(x.source, x.column, x.target, x.target_column, r) for x, r in inclusion.prefilter(rows, PRIMARY)], "source string, column_name string, target string, target_column string, reason string")


_KEYS_SQL = "k(tt, tc) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in PRIMARY) + ")"
# how far a column is named after a key's table: its name without id, against the table's name
_NAMED_SQL = (
    "nb AS (SELECT DISTINCT p.table_name AS nt, column_name AS nc, tt AS ntt, tt AS flat, CASE WHEN tt LIKE '%s' AND tt NOT LIKE '%ss' THEN left(tt, length(tt) - 1) ELSE tt END AS one, "
    "unnest([replace(regexp_replace(column_name, '_id$', ''), '_', ''), regexp_replace(column_name, 'id$', '')]) AS b FROM p CROSS JOIN k), "
    "nm AS (SELECT nt, nc, ntt, max(CASE WHEN b IN (flat, one) OR b || 's' = flat THEN 1.0 WHEN contains(flat, b) AND length(b) >= 0.7 * length(flat) OR contains(b, one) THEN 0.7 ELSE 0.0 END) AS ns FROM nb WHERE b <> '' AND b <> nc GROUP BY ALL)"
)
_PAIRS_SQL = (
    _profile_sql() + ", " + _KEYS_SQL + ", " + _NAMED_SQL + ", pairs AS (SELECT s.table_name AS source, s.column_name, k.tt AS target, k.tc AS target_column, coalesce(ns, 0.0) AS ns, s.num_rows AS srows, s.distinct_count AS sd, CASE "
    "WHEN s.table_name = k.tt AND s.column_name = k.tc THEN 'same-column' WHEN s.num_rows = 0 OR s.null_count = s.num_rows THEN 'empty' WHEN s.family <> t.family THEN 'type' WHEN coalesce(ns, 0.0) > 0 THEN '' "
    "WHEN s.distinct_count > t.distinct_count THEN 'cardinality' WHEN s.min_num < t.min_num OR s.max_num > t.max_num THEN 'range' ELSE '' END AS reason "
    "FROM p s CROSS JOIN k JOIN p t ON t.table_name = k.tt AND t.column_name = k.tc LEFT JOIN nm ON nt = s.table_name AND nc = s.column_name AND ntt = k.tt)"
)
add("pairs_prefilter", _pairs, "WITH " + _PAIRS_SQL + " SELECT source, column_name, target, target_column, reason FROM pairs")

CHECKED = [inclusion.Pair(x.table, x.column, x.target, x.target_column) for x in [ForeignKey(j.source, j.on[0][0], j.target, j.on[0][1]) for j in STAR_JOINS]] + [inclusion.Pair("events", "user_id", "customer", "c_custkey"), inclusion.Pair("part", "p_size", "nation", "n_nationkey"), inclusion.Pair("orders", "o_orderkey", "customer", "c_custkey"), inclusion.Pair("customer", "c_custkey", "supplier", "s_suppkey")]
add(
    "ind_containment",
    lambda s, d: inclusion.containment(star(s, d), CHECKED).withColumn("containment", F.round("containment", 9)),
    " UNION ALL ".join(
        f"SELECT '{x.source}' AS source, '{x.column}' AS column_name, '{x.target}' AS target, '{x.target_column}' AS target_column, count(*) AS src_distinct, count(*) FILTER (WHERE t.v IS NULL) AS missing, ROUND(count(*) FILTER (WHERE t.v IS NOT NULL) / count(*), 9) AS containment "
        f"FROM (SELECT DISTINCT {x.column} v FROM {x.source} WHERE {x.column} IS NOT NULL) s LEFT JOIN (SELECT DISTINCT {x.target_column} v FROM {x.target}) t ON s.v = t.v"
        for x in CHECKED
    ),
)


def _links(spark: SparkSession, folder: str) -> tuple[Catalog, list]:
    c = star(spark, folder)
    rows = profile.profile(c).collect()  # a row for each column
    kept = [x for x, r in inclusion.prefilter(rows, PRIMARY) if not r]
    return c, inclusion.foreign_keys(c, rows, PRIMARY, inclusion.containment(c, kept).collect())


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    _, links = _links(spark, folder)
    return spark.createDataFrame([(x.source, x.column, x.target, x.target_column, round(x.containment, 9), round(x.score, 4), x.kind, x.cardinality) for x in links], "source string, column_name string, target string, target_column string, containment double, score double, kind string, cardinality string")


_VALUES_SQL = "v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS vt, '{c}' AS vc, CAST({c} AS DOUBLE) AS v FROM {t} WHERE {c} IS NOT NULL" for t in STAR for c, k in COLS[t] if k == "n") + ")"
_SCORED_SQL = (
    "WITH " + _PAIRS_SQL + ", " + _VALUES_SQL + ", c AS (SELECT source, column_name, target, target_column, ns, srows, sd, count(b.v) / count(*) AS containment FROM pairs JOIN v a ON a.vt = source AND a.vc = column_name LEFT JOIN v b ON b.vt = target AND b.vc = target_column AND b.v = a.v WHERE reason = '' GROUP BY ALL HAVING count(b.v) / count(*) >= 0.7), "
    "q AS (SELECT *, count(*) OVER (PARTITION BY target, target_column) AS pop, EXISTS (SELECT 1 FROM k WHERE tt = source AND tc = column_name) AS skey FROM c) "
)
_SCORE = "ROUND(least(1.0, greatest(0.0, 0.15 + 0.7 * ns + CASE WHEN pop >= 2 THEN 0.1 ELSE 0 END - CASE WHEN ns < 0.5 THEN CASE WHEN skey THEN 0.3 ELSE 0 END + 0.2 ELSE 0 END)), 4)"
add("fk_scored", _scored, _SCORED_SQL + f"SELECT source, column_name, target, target_column, ROUND(containment, 9) AS containment, CAST({_SCORE} AS DOUBLE) AS score, CASE WHEN source = target THEN 'self-reference' ELSE 'foreign-key' END AS kind, CASE WHEN sd = srows THEN 'one-to-one' ELSE 'one-to-many' END AS cardinality FROM q")


def _trusted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(inclusion.trusted(*_links(spark, folder)), "source string, column_name string, target string, target_column string")


add(
    "fk_trusted", _trusted,
    _SCORED_SQL + "SELECT * FROM (VALUES " + ", ".join(f"('{j.source}', '{j.on[0][0]}', '{j.target}', '{j.on[0][1]}')" for j in STAR_JOINS) + ") t(source, column_name, target, target_column) "
    f"UNION SELECT source, column_name, target, target_column FROM q WHERE source <> target AND (ns >= 0.5 OR {_SCORE} >= 0.5)",
)


def _junction(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder, ("bridge",))
    pairs = [inclusion.Pair("bridge", "l_partkey", "part", "p_partkey"), inclusion.Pair("bridge", "l_suppkey", "supplier", "s_suppkey")]
    names = c.only(["bridge", "part", "supplier"])
    rows = profile.profile(names).collect()
    links = inclusion.foreign_keys(names, rows, [("part", "p_partkey"), ("supplier", "s_suppkey")], inclusion.containment(names, pairs).collect())
    keys = [(r["table_name"], tuple(r["columns"])) for r in profile.composite_keys(names, "bridge", [r for r in rows if r["table_name"] == "bridge"]).collect()]
    return spark.createDataFrame([(x.source, x.column, x.target, x.target_column, x.kind) for x in inclusion.many_to_many(links, keys)], "source string, column_name string, target string, target_column string, kind string")


add("fk_many_to_many", _junction, "SELECT 'part' AS source, 'p_partkey' AS column_name, 'supplier' AS target, 's_suppkey' AS target_column, 'many-to-many' AS kind")


def _composite_fk(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder, ("line_a", "line_b"))
    links = [("line_a", "l_orderkey", "orders", "o_orderkey"), ("line_a", "l_suppkey", "supplier", "s_suppkey"), ("line_b", "l_orderkey", "orders", "o_orderkey"), ("line_b", "l_suppkey", "supplier", "s_suppkey")]
    found = inclusion.composite_foreign_keys(c, links, [("line_b", ("l_orderkey", "l_suppkey"))], set())
    return spark.createDataFrame([(x["child"], "+".join(x["columns"]), x["parent"], "+".join(x["parent_columns"]), round(x["containment"], 9)) for x in found], "child string, columns string, parent string, parent_columns string, containment double")


add(
    "fk_composite", _composite_fk,
    cte("line_a", "line_b") + "SELECT 'line_a' AS child, 'l_orderkey+l_suppkey' AS columns, 'line_b' AS parent, 'l_orderkey+l_suppkey' AS parent_columns, ROUND(count(b.l_orderkey) / count(*), 9) AS containment FROM line_a a LEFT JOIN line_b b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey HAVING count(b.l_orderkey) / count(*) >= 0.7",
)
add("numeric_text_detect", lambda s, d: facts.numeric_text(star(s, d, ("ev_k",)), "ev_k"), cte("ev_k") + "SELECT 'ev_k' AS table_name, 'event_type' AS column_name, bool_and(regexp_matches(event_type, '^[+-]?[0-9.]+$')) AS is_numeric_text FROM ev_k UNION ALL SELECT 'ev_k', 'k', bool_and(regexp_matches(k, '^[+-]?[0-9.]+$')) FROM ev_k")
_DICT = [c for c, k in COLS["orders"] if k == "t"] + ["o_custkey"]
_DICT_SQL = "v AS (" + " UNION ALL ".join(f"SELECT DISTINCT 'orders' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders WHERE {c} IS NOT NULL" for c in _DICT) + ")"
add("value_dictionary", lambda s, d: facts.value_dictionary(star(s, d), "orders", _DICT), "WITH " + _DICT_SQL + " SELECT * FROM v WHERE column_name IN (SELECT column_name FROM v GROUP BY 1 HAVING count(*) <= 50)")
add("null_placeholder", lambda s, d: facts.null_placeholder(facts.value_dictionary(star(s, d, ("placeholder",)), "placeholder", ["p_type"], 500)), cte("placeholder") + "SELECT 'placeholder' AS table_name, 'p_type' AS column_name, min(p_type) AS placeholder FROM placeholder WHERE lower(trim(p_type)) IN ('', '-', '--', 'n/a', 'na', 'null', 'none', 'unknown', '?', '\\n')")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder)
    pr = profile.profile_table(c, "part")
    return facts.column_facts(pr, profile.single_keys(pr), facts.numeric_text(c, "part"), facts.null_placeholder(facts.value_dictionary(c, "part", ["p_brand", "p_type"]))).drop("data_type")


add(
    "column_facts", _facts,
    "WITH " + _profile_sql(["part"]) + ", z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, bool_and(regexp_matches({c}, '^[+-]?[0-9.]+$')) AS z FROM part" for c, k in COLS["part"] if k == "t") + ") "
    "SELECT table_name, column_name, num_rows, distinct_count, null_count > 0 AS nullable, distinct_count = num_rows AS is_unique, coalesce(z, FALSE) AS is_numeric_text, CAST(NULL AS VARCHAR) AS placeholder FROM p LEFT JOIN z ON c = column_name",
)

# ---------------------------------------------------------------- temporality


def _plans(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> list[tuple[Catalog, temporality.SequencePlan, list[str]]]:
    c = star(spark, folder, (*tables, "cal", "users"))
    out = []
    for t in tables:
        own = c.only([t, "cal", "users"])
        plan = temporality.sequence_plan(own, t, [(t, "user_id", "users", "user_id")])
        out.append((own, plan, temporality.measures(own, plan, set())))
    return out


def _over(function, *columns: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = None
        for c, plan, names in _plans(spark, folder, ("standings", "balance", "ev_daily")):
            d = function(c, plan, names) if columns else function(c, plan)
            d = d.select(F.lit(plan.table).alias("table_name"), *[F.round(x, 6).alias(x) if d.schema[x].dataType.typeName() == "double" else F.col(x) for x in d.columns])
            out = d if out is None else out.unionByName(d)
        return out

    return run


_STEP = "(SELECT CAST({m} AS DOUBLE) AS v, {m} - lag({m}) OVER (PARTITION BY t.user_id, c.season_year ORDER BY c.round) AS dd FROM {t} t JOIN cal c ON t.d = c.d) s"
_MEASURES = (("standings", "points"), ("balance", "points"), ("ev_daily", "amount"))
_ALL = cte("ev_daily", "cal", "standings", "balance")
add("temporal_monotonic", _over(temporality.monotonic, "measure"), _ALL + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{m}' AS measure, count(*) FILTER (WHERE dd < 0) AS negative, count(dd) AS total, ROUND((count(dd) - count(*) FILTER (WHERE dd < 0)) / count(dd), 6) AS ratio, (count(dd) - count(*) FILTER (WHERE dd < 0)) / count(dd) >= 0.99 AS is_cumulative FROM {_STEP.format(m=m, t=t)}" for t, m in _MEASURES))
add("temporal_grain_unique", _over(temporality.grain_is_unique), _ALL + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS total, count(DISTINCT (user_id, d)) AS keys, count(*) = count(DISTINCT (user_id, d)) AS is_unique FROM {t}" for t, _ in _MEASURES))
add("temporal_von_neumann", _over(temporality.von_neumann, "measure"), _ALL + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{m}' AS measure, ROUND(var_samp(dd) / var_samp(v), 6) AS ratio, ROUND(count(*) FILTER (WHERE dd <> 0) / count(dd), 6) AS moved, var_samp(dd) / var_samp(v) <= 0.1 AND count(*) FILTER (WHERE dd <> 0) / count(dd) >= 0.15 AS is_snapshot FROM {_STEP.format(m=m, t=t)}" for t, m in _MEASURES))

# -------------------------------------------------------------------- routing

_DEMO = [
    Join("a", "b", (("b_id", "id"),)), Join("b", "c", (("c_id", "id"),)), Join("a", "c", (("c_id", "id"),), confidence=0.6, provenance="discovered"),
    Join("c", "d", (("d_id", "id"),)), Join("b", "d", (("d_id", "id"),), confidence=0.8, provenance="discovered"), Join("d", "e", (("e_id", "id"),), confidence=0.3, provenance="discovered"),
]


def _route(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for tables in (["region", "orders"], ["part", "customer"], ["supplier", "part", "orders"]):
        path = routing.join_path(STAR_JOINS, tables)
        rows.append(("+".join(tables), "|".join(sorted(j.name for j in path.joins)), len(path.joins), path.low_confidence))
    low = routing.join_path(_DEMO, ["a", "e"])
    rows.append(("a+e", "|".join(sorted(j.name for j in low.joins)), len(low.joins), low.low_confidence))
    return spark.createDataFrame(rows, "tables string, joins string, n int, low_confidence boolean")


add(
    "route_join_path", _route,
    "SELECT * FROM (VALUES ('region+orders', 'customer.c_nationkey->nation|nation.n_regionkey->region|orders.o_custkey->customer', 3, FALSE), ('part+customer', 'lineitem.l_orderkey->orders|lineitem.l_partkey->part|orders.o_custkey->customer', 3, FALSE), "
    "('supplier+part+orders', 'lineitem.l_orderkey->orders|lineitem.l_partkey->part|lineitem.l_suppkey->supplier', 3, FALSE), ('a+e', 'a.b_id->b|b.d_id->d|d.e_id->e', 3, TRUE)) t(tables, joins, n, low_confidence)",
)
add(
    "route_k_best",
    lambda s, d: s.createDataFrame([(i + 1, ">".join(x.tables), round(x.score, 6)) for i, x in enumerate(routing.best_paths(_DEMO, "a", "d", 3))], "rank int, path string, score double"),
    "SELECT * FROM (VALUES (1, 'a>b>d', ROUND(1 / (1 + 1 + 1 / 0.64), 6)), (2, 'a>b>c>d', 0.25), (3, 'a>c>d', ROUND(1 / (1 + 1 / 0.36 + 1), 6))) t(rank, path, score)",
)
add(
    "route_coreference",
    lambda s, d: s.createDataFrame([(j.source, j.target, "|".join(f"{a}={b}" for a, b in j.on), j.confidence) for j in routing.co_references([Join("x", "p", (("p_id", "id"),)), Join("x", "q", (("q_id", "id"),)), Join("y", "p", (("p_ref", "id"),)), Join("y", "q", (("q_ref", "id"),)), Join("z", "p", (("p_id", "id"),))])], "source string, target string, on_columns string, confidence double"),
    "SELECT 'x' AS source, 'y' AS target, 'p_id=p_ref|q_id=q_ref' AS on_columns, CAST(0.75 AS DOUBLE) AS confidence",
)


def _steiner(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for t in (["region", "part"], ["orders", "supplier"], ["events", "orders"]):
        g = routing.steiner(STAR_JOINS, t)
        rows.append(("+".join(t), "|".join(g.tables), "|".join(g.bridges), len(g.joins), g.connected))
    return spark.createDataFrame(rows, "terminals string, tables string, bridges string, joins int, connected boolean")


add("route_steiner", _steiner, "SELECT * FROM (VALUES ('region+part', 'lineitem|nation|part|region|supplier', 'lineitem|nation|supplier', 4, TRUE), ('orders+supplier', 'lineitem|orders|supplier', 'lineitem', 2, TRUE), ('events+orders', 'events|orders', '', 0, FALSE)) t(terminals, tables, bridges, joins, connected)")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    """A question's terminals, the tree between them, and the request over that tree."""
    g = routing.steiner(STAR_JOINS, ["region", "lineitem"])
    m = star_model(tuple(g.tables))
    m.joins = g.joins
    r = Request(measures=(Measure(capability=METRICS[1].iri, alias="revenue"),), group_by=(p("region", "r_name"),))
    return compiler.compile_request(r, m, star(spark, folder).tables).frame.withColumn("revenue", F.round("revenue", 2))


add("route_to_result", _routed, "SELECT r_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")

# ----------------------------------------------------------- words and scores

_WORDS = ["The Fastest Laps", "Companies  in São-Paulo", "buses & classes!", "status of 3 Races"]
add("text_normalize", lambda s, d: s.createDataFrame([(w, text.normalize(w), " ".join(text.tokenize(w))) for w in _WORDS], "phrase string, normal string, tokens string"), "SELECT * FROM (VALUES ('The Fastest Laps', 'the fastest laps', 'fastest lap'), ('Companies  in São-Paulo', 'companies in sao paulo', 'company sao paulo'), ('buses & classes!', 'buses classes', 'bus class'), ('status of 3 Races', 'status of 3 races', 'status 3 race')) t(phrase, normal, tokens)")
_EDITS = [("ab", "ba", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("", "abc", 3), ("same", "same", 0), ("abcd", "acbd", 1)]
add("text_osa_distance", lambda s, d: s.createDataFrame([(a, b, text.osa_distance(a, b)) for a, b, _ in _EDITS], "a string, b string, distance int"), "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in _EDITS) + ") t(a, b, distance)")
add("name_similarity", lambda s, d: s.createDataFrame([(c, t, inclusion.name_similarity(c, t)) for c, t in (("customer_id", "customers"), ("customerId", "customer"), ("orderid", "orders"), ("region", "nation"), ("o_custkey", "customer"))], "column_name string, table_name string, score double"), "SELECT * FROM (VALUES ('customer_id', 'customers', 1.0), ('customerId', 'customer', 1.0), ('orderid', 'orders', 1.0), ('region', 'nation', 0.0), ('o_custkey', 'customer', 0.0)) t(column_name, table_name, score)")


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    c = star(spark, folder)
    n = c.tables["nation"]
    a = n.select("n_nationkey", "n_name")
    cases = {
        "same": (a, a), "order": (a, a.orderBy(F.desc("n_name"))), "numeric text": (a, a.select(F.col("n_nationkey").cast("string"), "n_name")),
        "near": (a, a.select((F.col("n_nationkey") * (1 + 1e-14)).alias("k"), "n_name")), "far": (a, a.select(F.col("n_nationkey") + 1, "n_name")), "width": (a, n), "fewer": (a, a.limit(3)), "twice": (a, a.union(a)), "both empty": (a.limit(0), n.limit(0)),
    }
    return spark.createDataFrame([(k, matching.match_sets(x, y), matching.match_strict(x, y)) for k, (x, y) in cases.items()], "case_name string, loose boolean, strict boolean")


add("eval_match", _matches, "SELECT * FROM (VALUES ('same', TRUE, TRUE), ('order', TRUE, TRUE), ('numeric text', TRUE, FALSE), ('near', TRUE, FALSE), ('far', FALSE, FALSE), ('width', FALSE, FALSE), ('fewer', FALSE, FALSE), ('twice', TRUE, TRUE), ('both empty', TRUE, TRUE)) t(case_name, loose, strict)")
_CELLS = [("1", 1, True), ("2.0", 2, True), (None, None, True), (None, 0, False), ("abc", "ABC", False), (1.0, 1.0000001, True), (1.0, 1.001, False), ("12abc", 12, False), ("007", 7, True)]
add("eval_cells", lambda s, d: s.createDataFrame([(i, matching.cells_equal(a, b)) for i, (a, b, _) in enumerate(_CELLS)], "i int, equal boolean"), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(x).upper()})" for i, (_, _, x) in enumerate(_CELLS)) + ") t(i, equal)")
_SOFT = [([], [], 1.0), ([(1, 2)], [(1, 2)], 1.0), ([(1, 2)], [(2, 1)], 1.0), ([(1, 2)], [], 0.0), ([(1, 2), (3, 4)], [(1, 2)], 2 / 3), ([(1, 2)], [(1, 9)], 0.5)]
add("eval_soft_f1", lambda s, d: s.createDataFrame([(i, round(matching.soft_f1(g, c), 6)) for i, (g, c, _) in enumerate(_SOFT)], "i int, f1 double"), "SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({round(x, 6)} AS DOUBLE))" for i, (_, _, x) in enumerate(_SOFT)) + ") t(i, f1)")


def _numeric(spark: SparkSession, folder: str) -> DataFrame:
    o = star(spark, folder).tables["orders"].groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    same, off = matching.numeric_series(o, o.select("o_orderstatus", "v")), matching.numeric_series(o, o.select("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("v") + 5).otherwise(F.col("v"))))
    return same.select(F.lit("same").alias("case_name"), "correct", F.round("max_diff", 3).alias("max_diff")).unionByName(off.select(F.lit("off").alias("case_name"), "correct", F.round("max_diff", 3).alias("max_diff")))


add("eval_numeric", _numeric, "SELECT * FROM (VALUES ('same', TRUE, CAST(0 AS DOUBLE)), ('off', FALSE, CAST(5 AS DOUBLE))) t(case_name, correct, max_diff)")
_JOIN_SQL = "SELECT c.c_name FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey, nation n WHERE n.n_nationkey = c.c_nationkey AND o.o_orderstatus = 'x.y = z.w'"
add("eval_join_pairs", lambda s, d: s.createDataFrame(sorted(matching.join_pairs(_JOIN_SQL)), "a string, b string"), "SELECT * FROM (VALUES ('customer.c_custkey', 'orders.o_custkey'), ('customer.c_nationkey', 'nation.n_nationkey')) t(a, b)")
add("eval_join_prf", lambda s, d: s.createDataFrame([(i, *map(float, matching.join_scores(set(a), set(b)))) for i, (a, b) in enumerate([("", ""), ("xy", "yz"), ("", "x"), ("x", "")])], "i int, p double, r double, f1 double"), "SELECT i, CAST(p AS DOUBLE) AS p, CAST(r AS DOUBLE) AS r, CAST(f1 AS DOUBLE) AS f1 FROM (VALUES (0, 1.0, 1.0, 1.0), (1, 0.5, 0.5, 0.5), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)) t(i, p, r, f1)")
add("eval_top_level_order", lambda s, d: s.createDataFrame([(i, matching.top_level_order(q)) for i, q in enumerate(["SELECT 1 ORDER BY 1", "SELECT * FROM (SELECT 1 ORDER BY 1) t", "SELECT 'order by' x", "WITH a AS (SELECT 1) SELECT * FROM a ORDER BY 1 LIMIT 2"])], "i int, ordered boolean"), "SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, FALSE), (3, TRUE)) t(i, ordered)")
_RUN = "SELECT CAST(l_orderkey % 4 AS INT) AS stratum, l_linenumber % 2 = 0 AS strict, l_linenumber % 3 > 0 AS loose, CAST(l_discount AS DOUBLE) AS soft, CASE WHEN l_linenumber < 4 THEN l_linenumber = 2 END AS numeric, CAST(l_partkey % 1000 AS INT) AS latency_ms, CAST(l_suppkey AS BIGINT) AS tokens, CAST(l_quantity AS DOUBLE) AS gold_ms, CAST(l_linenumber * 5 AS DOUBLE) AS cand_ms FROM lineitem"


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    star(spark, folder)
    d = matching.summarize(spark.sql(_RUN), ["stratum"])
    return d.select("stratum", "n", "strict", "loose", "disagreements", F.round("soft_f1", 6).alias("soft_f1"), "numeric_correct", "numeric_total", F.round("r_ves", 4).alias("r_ves"), "p50", "p95", F.round("tokens_per_correct", 4).alias("tokens_per_correct"))


_REWARD = "CASE WHEN gold_ms / cand_ms >= 2 THEN 1.25 WHEN gold_ms / cand_ms >= 1 THEN 1 WHEN gold_ms / cand_ms >= 0.5 THEN 0.75 WHEN gold_ms / cand_ms >= 0.25 THEN 0.5 ELSE 0.25 END"
add(
    "eval_aggregate", _summary,
    f"SELECT stratum, count(*) AS n, CAST(sum(CAST(strict AS INT)) AS BIGINT) AS strict, CAST(sum(CAST(loose AS INT)) AS BIGINT) AS loose, CAST(sum(CAST(strict <> loose AS INT)) AS BIGINT) AS disagreements, ROUND(avg(soft), 6) AS soft_f1, CAST(sum(CAST(numeric AS INT)) AS BIGINT) AS numeric_correct, count(numeric) AS numeric_total, "
    f"ROUND(sum(CASE WHEN strict THEN sqrt({_REWARD}) * 100 ELSE 0 END) / count(*), 4) AS r_ves, CAST(quantile_disc(latency_ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) AS p95, ROUND(sum(tokens) / sum(CAST(strict AS INT)), 4) AS tokens_per_correct FROM ({_RUN}) r GROUP BY 1",
)


# --------------------------------------------------- questions and ontology


def _question_model() -> Model:
    m = star_model(tuple(t for t in STAR if t != "events"))
    m.column("customer", "c_mktsegment").samples = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    m.column("customer", "c_mktsegment").distinct = 5
    for t, c, label in (("region", "r_name", "region name"), ("nation", "n_name", "nation name"), ("customer", "c_mktsegment", "market segment"), ("orders", "o_orderpriority", "priority")):
        m.column(t, c).label = label
    return m


_QUESTIONS = ["revenue by region name", "order value per priority for building customers", "top 3 nation name by revenue in asia"]


def _anchored(spark: SparkSession, folder: str) -> DataFrame:
    m = _question_model()
    index = anchor.build_index(m)
    rows = []
    for q in _QUESTIONS:
        found = anchor.anchor(q, index)
        rows += [(q, h.kind, h.table, h.name, h.value) for h in found.hits if h.kind in ("value", "metric") and h.score >= 0.95]
    return spark.createDataFrame(rows, "question string, kind string, table_name string, name string, value string")


add(
    "anchor_hits", _anchored,
    "SELECT * FROM (VALUES ('revenue by region name', 'metric', 'lineitem', 'tsr:capability/revenue', ''), ('order value per priority for building customers', 'metric', 'orders', 'tsr:capability/order-value', ''), "
    "('order value per priority for building customers', 'value', 'customer', 'c_mktsegment', 'BUILDING'), ('top 3 nation name by revenue in asia', 'metric', 'lineitem', 'tsr:capability/revenue', ''), ('top 3 nation name by revenue in asia', 'value', 'region', 'r_name', 'ASIA')) t(question, kind, table_name, name, value)",
)


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    """A question's words become a request, which is compiled over the tree between its tables."""
    m = _question_model()
    request, _ = anchor.link(_QUESTIONS[1], m, anchor.build_index(m))
    return compiler.compile_request(request, m, star(spark, folder).tables).frame.withColumn("value", F.round("value", 2))


add("link_to_result", _linked, "SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    m = _question_model()

    def plan(question: str, shown: str, issues: list[str]) -> Request:
        value = "Asien" if not issues else "asia"  # the first try is refused, the second put right
        return Request(measures=(Measure(capability=METRICS[0].iri, alias="value"),), group_by=(p("nation", "n_name"),), filters=(Filter(p("region", "r_name"), "=", value),))

    answer = planner.ask("order value by nation name in asia", m, star(spark, folder).tables, plan)
    if answer.frame is None:
        raise RuntimeError(f"{answer.failed}: {answer.message}")
    return answer.frame.withColumn("value", F.round("value", 2))


add("pipeline_end_to_end", _asked, "SELECT n_name, ROUND(SUM(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")


def _grain(spark: SparkSession, folder: str) -> DataFrame:
    ev = Evidence(("driver_id", "year"), "round")
    m = Model(
        {"results": [Column("driver_id"), Column("race_id"), Column("points")], "standings": [Column("driver_id"), Column("race_id"), Column("points", temporality="cumulative-snapshot", evidence=ev)], "drivers": [Column("id", key=True)], "races": [Column("race_id", key=True), Column("year"), Column("round")]},
        [Join("results", "drivers", (("driver_id", "id"),)), Join("standings", "drivers", (("driver_id", "id"),)), Join("standings", "races", (("race_id", "race_id"),))],
    )
    a, b = p("results", "points"), p("standings", "points")
    cases = {"max of events": (Measure(fn="MAX", property=a), ()), "sum of totals": (Measure(fn="SUM", property=b), ()), "sum of events": (Measure(fn="SUM", property=a), ()), "pinned": (Measure(fn="MAX", property=a), (Filter(p("races", "round"), "=", 9),))}
    rows = []
    for name, (measure, where) in cases.items():
        r = grain.resolve(Request(measures=(measure,), filters=where), m)
        rows.append((name, r.shape, r.request.measures[0].property, len(r.ambiguous)))
    return spark.createDataFrame(rows, "case_name string, shape string, property string, ambiguous int")


add("grain_resolve", _grain, "SELECT * FROM (VALUES ('max of events', 'max-or-latest', 'tsr:property/standings/points', 0), ('sum of totals', 'agg-over-events', 'tsr:property/results/points', 0), ('sum of events', 'agg-over-events', 'tsr:property/results/points', 0), ('pinned', 'as-of-event', 'tsr:property/results/points', 1)) t(case_name, shape, property, ambiguous)")


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    e = parse_evidence("big customers refers to MAX(c_acctbal); segment refers to c_mktsegment = 'BUILDING'; something odd", _question_model())
    rows = [("filter", f.property, str(f.value)) for f in e.filters] + [("order", e.order.property, "desc" if e.order.descending else "asc")] + [("alias", v, k) for k, v in e.aliases.items()] + [("unread", "", u) for u in e.unread]
    return spark.createDataFrame(rows, "kind string, property string, value string")


add("link_evidence", _evidence, "SELECT * FROM (VALUES ('filter', 'tsr:property/customer/c_mktsegment', 'BUILDING'), ('order', 'tsr:property/customer/c_acctbal', 'desc'), ('alias', 'tsr:property/customer/c_acctbal', 'big customers'), ('alias', 'tsr:property/customer/c_mktsegment', 'segment'), ('unread', '', 'something odd')) t(kind, property, value)")
add("superlative_grounded", lambda s, d: s.createDataFrame([anchor.superlative("the latest orders", _question_model(), ["orders", "customer"])], "table_name string, column_name string, direction string"), "SELECT 'orders' AS table_name, 'o_orderdate' AS column_name, 'desc' AS direction")
add("grounding_slice", lambda s, d: s.createDataFrame([(i, t) for i, t in enumerate(grounding_slice(_question_model(), ["orders"]))], "i int, table_name string"), "SELECT * FROM (VALUES (0, 'orders'), (1, 'customer'), (2, 'lineitem')) t(i, table_name)")


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    m = star_model(("orders", "customer", "nation"))
    m.joins = [*m.joins, Join("orders", "nation", (("o_orderkey", "n_nationkey"),), confidence=0.05, provenance="discovered")]
    return ontology.fragments(spark, "star", ontology.tier(ontology.assemble(m))).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


add("onto_tiering", _fragments, "SELECT * FROM (VALUES ('class', 'asserted', CAST(3 AS BIGINT)), ('property', 'asserted', 14), ('relation', 'asserted', 2), ('relation', 'candidate', 1), ('metric', 'asserted', 2)) t(kind, tier, n)")


def _invalid(spark: SparkSession, folder: str) -> DataFrame:
    m = star_model(("orders", "customer"))
    m.metrics = [Metric("tsr:capability/a", "SUM(orders.o_nothing)", ("orders",), "A"), Metric("tsr:capability/b", "AVG(orders.o_totalprice)", ("orders",), "B"), Metric("tsr:capability/c", "COUNT(orders.o_orderkey)", ("orders",), "B")]
    return spark.createDataFrame(ontology.validate(ontology.assemble(m), m), "iri string, problem string")


add("onto_validate", _invalid, "SELECT * FROM (VALUES ('tsr:capability/a', 'unknown column orders.o_nothing'), ('tsr:capability/c', 'label ''B'' is that of tsr:capability/b')) t(iri, problem)")


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    a, b = star_model(("orders", "customer")), star_model(("orders", "customer", "nation"))
    b.column("orders", "o_totalprice").temporality = "cumulative-snapshot"
    d = [x for x in ontology.diff(ontology.assemble(a), ontology.assemble(b)) if "nation" not in x[0]]
    return spark.createDataFrame(d, "iri string, change string, key string")


add("onto_diff", _changed, "SELECT 'tsr:property/orders/o_totalprice' AS iri, 'temporality' AS change, 'temporality' AS key")


# ------------------------------------------------------------- linking by rules


def _by_links(question: str, evidence: str = "", rounded: tuple[str, ...] = ()):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        m = _question_model()
        got = linker.answer(question, m, star(spark, folder).tables, hints=parse_evidence(evidence, m) if evidence else None).frame
        return got.withColumns({r: F.round(r, 2) for r in rounded}) if rounded else got

    return run


add("linker_grouped", _by_links("order value per priority for building", rounded=("value",)), "SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
add("linker_ranked", _by_links("top 5 order value: show the market segment"), "SELECT c_mktsegment FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY o_totalprice DESC) AS i FROM orders JOIN customer ON o_custkey = c_custkey) WHERE i <= 5")
add("linker_by_number", _by_links("list the priority for custkey 7", evidence="custkey refers to o_custkey"), "SELECT o_orderpriority FROM orders WHERE o_custkey = 7")
add("linker_all_columns", _by_links("europe"), "SELECT * FROM region WHERE r_name = 'EUROPE'")
add("linker_filters", _by_links("show nation name of asia and africa"), "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA')")


def _discovered(spark: SparkSession, folder: str) -> DataFrame:
    """Relations that a build finds over tables with a junction and two-column references."""
    c = star(spark, folder, ("bridge", "line_a", "line_b"))
    c = replace(c.only(["part", "supplier", "orders", "bridge", "line_a", "line_b"]), keys=[], links=[ForeignKey(t, a, b, k) for t, a, b, k in (("bridge", "l_partkey", "part", "p_partkey"), ("bridge", "l_suppkey", "supplier", "s_suppkey"), *((x, "l_orderkey", "orders", "o_orderkey") for x in ("line_a", "line_b")), *((x, "l_suppkey", "supplier", "s_suppkey") for x in ("line_a", "line_b")))])
    rows = profile.profile(c).collect()  # a row for each column
    trusted = inclusion.trusted(c, [])
    singles = {(r["table_name"], r["column_name"]) for r in rows if r["num_rows"] and r["uniqueness_ratio"] == 1}
    joins = build._pair_joins(c, rows, [], trusted, singles)
    return spark.createDataFrame([(j.source, j.target, j.cardinality, "+".join(a for a, _ in j.on), round(j.confidence, 9)) for j in joins], "source string, target string, cardinality string, columns string, confidence double")


def _both_ways(a: str, b: str) -> str:
    return f"SELECT '{a}' AS source, '{b}' AS target, 'many-to-one' AS cardinality, 'l_orderkey+l_suppkey' AS columns, ROUND(count(y.l_orderkey) / count(*), 9) AS confidence FROM {a} x LEFT JOIN {b} y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey = y.l_suppkey HAVING count(y.l_orderkey) / count(*) >= 0.7"


add(
    "onto_pair_relations", _discovered,
    cte("bridge", "line_a", "line_b") + _both_ways("line_a", "line_b") + " UNION ALL " + _both_ways("line_b", "line_a") + " UNION ALL SELECT 'part', 'supplier', 'many-to-many', '', 1.0 WHERE (SELECT count(*) = count(DISTINCT (l_partkey, l_suppkey)) FROM bridge)"
    " UNION ALL SELECT 'orders', 'supplier', 'many-to-many', '', 1.0 FROM (VALUES (1), (2))",
)


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Values of different numeric types are met as numbers."""
    c = star(spark, folder)
    o = c.tables["orders"]
    c.tables["typed"] = o.select(F.col("o_custkey").cast("double").alias("d"), F.col("o_custkey").cast("decimal(12,2)").alias("m"), F.col("o_custkey").cast("int").alias("i"), (F.col("o_custkey") + 0.5).alias("h"), F.col("o_orderdate").cast("date").alias("t"))
    pairs = [inclusion.Pair("typed", x, "customer", "c_custkey") for x in "dmih"] + [inclusion.Pair("customer", "c_custkey", "typed", x) for x in "dmi"] + [inclusion.Pair("typed", "d", "typed", "m"), inclusion.Pair("typed", "t", "orders", "o_orderdate")]
    return inclusion.containment(c, pairs).withColumn("containment", F.round("containment", 9))


def _mixed_sql() -> str:
    out = ["WITH typed AS (SELECT CAST(o_custkey AS DOUBLE) AS d, CAST(o_custkey AS DECIMAL(12,2)) AS m, CAST(o_custkey AS INTEGER) AS i, o_custkey + 0.5 AS h, CAST(o_orderdate AS DATE) AS t FROM orders) "]
    pairs = [("typed", x, "customer", "c_custkey") for x in "dmih"] + [("customer", "c_custkey", "typed", x) for x in "dmi"] + [("typed", "d", "typed", "m"), ("typed", "t", "orders", "o_orderdate")]
    return out[0] + " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{a}' AS column_name, '{t}' AS target, '{b}' AS target_column, count(*) AS src_distinct, count(*) FILTER (WHERE y.v IS NULL) AS missing, ROUND(count(y.v) / count(*), 9) AS containment FROM (SELECT DISTINCT {a} v FROM {s}) x LEFT JOIN (SELECT DISTINCT {b} v FROM {t}) y ON x.v = y.v"
        for s, a, t, b in pairs
    )


add("ind_mixed_types", _mixed, _mixed_sql())


def _soft_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Partial credit and ordered match over whole results: each nation against its neighbour by key."""
    n = star(spark, folder).tables["nation"].select("n_nationkey", "n_name", "n_regionkey")
    other = n.select("n_nationkey", F.upper("n_name").alias("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise(-1).alias("n_regionkey"))
    a, b = n.orderBy("n_nationkey"), other.orderBy("n_nationkey")
    got = matching.soft_scores(a, b, ordered=True).withColumn("f1", F.round("f1", 9))
    return got.withColumns({"in_place": F.lit(matching.match_in_place(a, b)), "itself": F.lit(matching.match_in_place(a, n.orderBy(F.col("n_nationkey")))), "reversed": F.lit(matching.match_in_place(a, n.orderBy(F.desc("n_nationkey"))))})


add(
    "eval_soft_rows", _soft_rows,
    "WITH r AS (SELECT [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] AS g, [CAST(n_nationkey AS VARCHAR), upper(n_name), CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE -1 END AS VARCHAR)] AS c FROM nation), "
    "s AS (SELECT sum(len(list_filter(c, lambda x: list_contains(g, x))) / 3.0) AS tp, sum(len(list_filter(c, lambda x: NOT list_contains(g, x))) / 3.0) AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(c, x))) / 3.0) AS fn FROM r) "
    "SELECT ROUND(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, FALSE AS in_place, TRUE AS itself, FALSE AS reversed FROM s",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
