"""Queries of the engine over the driver's tables, most of them pipeline documents, and the SQL that they match."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extras
from .plans import profile as profiles
from .plans import sketches
from .functions.coerce import name as column
from .operators.shared import work_dir
from .plans.pipeline import run
from .sources import files
from .sources.exports import export_lines, write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(*nodes: tuple[str, dict[str, Any]], **ports: str) -> dict[str, Any]:
    """A document whose nodes follow one another; `ports` binds inputs, by their table's name, to a port of the node that has one."""
    made = [{"id": "in", "type": "input"}, *({"id": f"n{i}", "type": t, "config": c} for i, (t, c) in enumerate(nodes)), {"id": "out", "type": "output"}]
    edges = [{"from": a["id"], "to": b["id"]} for a, b in zip(made, made[1:], strict=False)]
    taking = {"join": "right", "lookupEnrich": "reference", "union": "b"}
    for port, source in ports.items():
        made.append({"id": source, "type": "input"})
        edges.append({"from": source, "to": next(n["id"] for n in made if taking.get(n["type"]) == port), "toPort": port})
    return {"version": 1, "nodes": made, "edges": edges}


def add(name: str, source: str, nodes: list[tuple[str, dict[str, Any]]], sql: str, then: Callable[[DataFrame], DataFrame] | None = None, **ports: str) -> None:
    """Register a pipeline over one table, further ones at ports, and its SQL; `then` rounds what float sums give."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = {"in": table(spark, sf_dir, source)} | {t: table(spark, sf_dir, t) for t in ports.values()}
        df = run(chain(*nodes, **ports), sources)
        return then(df) if then else df

    QUERIES[name], ORACLE_SQL[name] = query, sql


def rounding(**digits: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def gen(column: str, expression: str) -> tuple[str, dict[str, Any]]:
    return "generateColumn", {"column": column, "expression": expression}


def select(*columns: str) -> tuple[str, dict[str, Any]]:
    return "selectColumns", {"columns": list(columns)}


# The flagship: filter, formula, grouping and sort
add("flagship", "lineitem", [
    ("filterRows", {"expression": 'l_quantity > 25 && l_returnflag == "R"'}), gen("revenue", "l_extendedprice * (1 - l_discount)"),
    ("groupByAggregate", {"keys": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "revenue", "func": "sum", "as": "revenue"}, {"column": "l_quantity", "func": "avg", "as": "avg_qty"}, {"column": "l_orderkey", "func": "count", "as": "n"}]}),
    ("sort", {"keys": [{"column": "l_linestatus", "desc": False}]}),
], "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R' GROUP BY ALL", rounding(revenue=2, avg_qty=4))

# Projection
add("select_missing", "orders", [select("o_orderkey", "o_orderstatus", "nothing")], "SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS nothing FROM orders", lambda d: d.withColumn("nothing", F.col("nothing").cast("string")))
add("rename_swap", "nation", [("renameColumns", {"mapping": {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}})], "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")
add("cast_types", "events", [gen("s", 'concat(event_type, "")'), ("mapValues", {"column": "s", "mapping": {"error": "yes", "click": "T", "view": "0", "purchase": "12.9"}}), gen("b", "s"), gen("f", "s"),
    ("typeCast", {"casts": {"s": "integer", "b": "boolean", "f": "float", "user_id": "string", "value": "integer"}}), select("event_id", "s", "b", "f", "user_id", "value")],
    """WITH m AS (SELECT *, CASE event_type WHEN 'error' THEN 'yes' WHEN 'click' THEN 'T' WHEN 'view' THEN '0' WHEN 'purchase' THEN '12.9' ELSE event_type END AS s0 FROM events)
    SELECT event_id, CAST(trunc(TRY_CAST(s0 AS DOUBLE)) AS BIGINT) AS s, CASE WHEN s0 IN ('1','t','T','TRUE','true','True') THEN true WHEN s0 IN ('0','f','F','FALSE','false','False') THEN false END AS b,
    TRY_CAST(s0 AS DOUBLE) AS f, CAST(user_id AS VARCHAR) AS user_id, CAST(trunc(value) AS BIGINT) AS value FROM m""")  # fmt: skip
NULLED = 'if(c_custkey % 7 == 0, nothing, c_acctbal)', "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"
add("fill_static", "customer", [gen("b", NULLED[0]), ("fillMissingValues", {"fills": {"b": 1.5}}), select("c_custkey", "b")], f"SELECT c_custkey, coalesce({NULLED[1]}, 1.5::DOUBLE) AS b FROM customer")
add("fill_mean", "customer", [gen("b", NULLED[0]), ("fillMissingValues", {"fills": {"b": None}, "strategy": "mean"}), select("c_custkey", "b")],
    f"WITH x AS (SELECT c_custkey, {NULLED[1]} AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT avg(b) FROM x)), 4) AS b FROM x", rounding(b=4))
add("fill_mode", "customer", [gen("s", 'if(c_custkey % 5 == 0, "", c_mktsegment)'), ("fillMissingValues", {"fills": {"s": None}, "strategy": "mode"}), select("c_custkey", "s")],
    """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS s FROM customer), m AS (SELECT s, count(*) AS n FROM x WHERE s <> '' GROUP BY s ORDER BY n DESC, s LIMIT 1)
    SELECT c_custkey, CASE WHEN s = '' THEN (SELECT s FROM m) ELSE s END AS s FROM x""")  # fmt: skip
add("regex_group", "pages", [("regexExtract", {"column": "url", "pattern": r"://(?P<host>[^/]+)/", "targetColumn": "host"}), select("page_id", "host")], "SELECT page_id, CASE WHEN regexp_matches(url, '://([^/]+)/') THEN regexp_extract(url, '://([^/]+)/', 1) END AS host FROM pages")
add("regex_whole", "customer", [("regexExtract", {"column": "c_name", "pattern": "0*[1-9][0-9]*$"}), select("c_custkey", "c_name_extracted")], "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '0*[1-9][0-9]*$') THEN regexp_extract(c_name, '0*[1-9][0-9]*$') END AS c_name_extracted FROM customer")
add("split_column", "orders", [("splitColumn", {"column": "o_orderpriority", "delimiter": "-", "targetColumns": ["level", "label", "more"]}), select("o_orderkey", "level", "label", "more")],
    "SELECT o_orderkey, trim(string_split(o_orderpriority, '-')[1]) AS level, trim(string_split(o_orderpriority, '-')[2]) AS label, trim(string_split(o_orderpriority, '-')[3]) AS more FROM orders")
add("merge_column", "supplier", [gen("gone", 'if(s_suppkey % 3 == 0, nothing, s_name)'), ("mergeColumn", {"columns": ["s_nationkey", "gone", "s_acctbal"], "targetColumn": "m", "separator": "/"}), select("s_suppkey", "m")],
    "SELECT s_suppkey, concat_ws('/', CAST(s_nationkey AS VARCHAR), CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, regexp_replace(regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS VARCHAR), '0+$', ''), '\\.$', '')) AS m FROM supplier")
for _op, _sql in {"upper": "upper(p_name)", "lower": "lower(p_type)", "trim": "trim(p_name)", "title": "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')", "capitalize": "upper(p_name[1]) || p_name[2:]"}.items():
    _col = "p_type" if _op == "lower" else "p_name"
    add(f"string_{_op}", "part", [("stringTransform", {"column": _col, "operation": _op}), select("p_partkey", _col)], f"SELECT p_partkey, {_sql} AS {_col} FROM part")
add("map_default", "orders", [("mapValues", {"column": "o_orderstatus", "mapping": {"F": "finished", "O": "open"}, "default": "other"}), select("o_orderkey", "o_orderstatus")], "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders")
add("map_keep", "orders", [("mapValues", {"column": "o_orderstatus", "mapping": {"F": "finished"}}), select("o_orderkey", "o_orderstatus")], "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS o_orderstatus FROM orders")
add("flatten_json", "events", [("flattenJSON", {"column": "props", "schema": "struct<k:bigint>"}), select("event_id", "props.k")], "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")

# Filters, formulas
add("filter_formula", "lineitem", [("filterRows", {"expression": 'l_discount >= 0.05 && (l_returnflag == "A" || l_tax < 0.02) && !(l_linenumber > 5)'}), select("l_orderkey", "l_partkey", "l_linenumber")],
    "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05 AND (l_returnflag = 'A' OR l_tax < 0.02) AND NOT l_linenumber > 5")
add("filter_null_first", "events", [gen("v", "if(event_id % 4 == 0, nothing, value)"), ("filterRows", {"expression": "v < 5"}), select("event_id")], "SELECT event_id FROM events WHERE event_id % 4 = 0 OR value < 5")
add("formula_arithmetic", "lineitem", [gen("a", "-l_quantity + l_extendedprice / l_quantity * 2 - 1"), gen("m", "l_partkey % 7"), select("l_orderkey", "l_partkey", "a", "m")],
    "SELECT l_orderkey, l_partkey, -l_quantity + l_extendedprice / l_quantity * 2 - 1 AS a, CAST(l_partkey % 7 AS DOUBLE) AS m FROM lineitem")
add("formula_row_errors", "lineitem", [gen("x", "l_extendedprice / (l_linenumber - 3)"), ("filterRows", {"expression": "100 % (l_linenumber - 2) >= 0"}), select("l_orderkey", "l_partkey", "l_linenumber", "x")],
    "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / (l_linenumber - 3) END AS x FROM lineitem WHERE l_linenumber <> 2")
add("formula_strings", "part", [
    gen("a", 'contains(p_name, "ring")'), gen("b", 'startswith(p_type, "ECO") && !endswith(p_name, "x")'), gen("c", 'upper(substr(p_name, 1, 4)) + "-" + len(p_name)'), gen("d", 'replace(lower(p_brand), "brand#", "b")'), gen("e", 'trim(concat("  ", p_size, " "))'),
    select("p_partkey", "a", "b", "c", "d", "e"),
], "SELECT p_partkey, contains(p_name, 'ring') AS a, starts_with(p_type, 'ECO') AND NOT suffix(p_name, 'x') AS b, upper(substr(p_name, 2, 3)) || '-' || length(p_name) AS c, replace(lower(p_brand), 'brand#', 'b') AS d, CAST(p_size AS VARCHAR) AS e FROM part")
add("formula_numbers", "lineitem", [gen("a", "round(l_extendedprice * l_tax, 1)"), gen("b", "abs(l_quantity - 25)"), gen("c", "min(l_quantity, 10, l_linenumber)"), gen("d", "max(l_quantity, 10)"), select("l_orderkey", "l_partkey", "a", "b", "c", "d")],
    """SELECT l_orderkey, l_partkey, (floor(l_extendedprice * l_tax * 10) + CASE WHEN l_extendedprice * l_tax * 10 - floor(l_extendedprice * l_tax * 10) >= 0.5 THEN 1 ELSE 0 END) / 10 AS a, abs(l_quantity - 25) AS b,
    least(l_quantity, 10, l_linenumber)::DOUBLE AS c, greatest(l_quantity, 10)::DOUBLE AS d FROM lineitem""")  # fmt: skip
add("formula_nulls", "events", [gen("n", "if(event_id % 3 == 0, nothing, value)"), gen("s", 'if(event_id % 2 == 0, "", event_type)'), gen("a", "n ?? -1"), gen("b", 'coalesce(s, "none")'), gen("c", "isnull(n) || isempty(s)"), gen("d", "n == nothing"), select("event_id", "a", "b", "c", "d")],
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE value END::DOUBLE AS a, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE event_type END AS b, event_id % 3 = 0 OR event_id % 2 = 0 AS c, event_id % 3 = 0 AS d FROM events""")  # fmt: skip
add("formula_dates", "orders", [gen("y", "year(o_orderdate)"), gen("m", "month(o_orderdate)"), gen("d", 'day(concat(substr(o_orderpriority, 0, 0), "2024/02/0", substr(o_orderpriority, 0, 1)))'), select("o_orderkey", "y", "m", "d")],
    "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, CAST(o_orderpriority[1] AS DOUBLE) AS d FROM orders")
add("formula_loose_equal", "part", [gen("t", 'concat(p_size, ".0")'), gen("a", "p_size == t"), gen("b", "t == p_size"), gen("c", 't >= p_size'), select("p_partkey", "a", "b", "c")], "SELECT p_partkey, true AS a, false AS b, true AS c FROM part")
add("validate_schema", "lineitem", [("validateSchema", {"rules": [{"column": "l_quantity", "kind": "min", "value": "10"}, {"column": "l_tax", "kind": "max", "value": "0.05"}, {"column": "l_returnflag", "kind": "enum", "value": "A, R"}, {"column": "l_linestatus", "kind": "notNull"}, {"column": "l_partkey", "kind": "unknown"}]}), select("l_orderkey", "l_partkey")],
    "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_tax <= 0.05 AND l_returnflag IN ('A', 'R')")

# Joins, unions
for _how in ("inner", "left", "right", "full"):
    add(f"join_{_how}", "orders", [gen("key", "if(o_custkey % 5 == 0, nothing, o_custkey)"), ("join", {"joinType": _how, "leftKeys": ["key"], "rightKeys": ["c_custkey"]}), select("o_orderkey", "key", "c_custkey", "c_name")],
        f"WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END::DOUBLE AS key FROM orders) SELECT o_orderkey, key, c_custkey, c_name FROM o {_how} JOIN customer ON key IS NOT DISTINCT FROM c_custkey", right="customer")
add("join_cross", "region", [("join", {"joinType": "cross"}), select("r_name", "n_name")], "SELECT r_name, n_name FROM region CROSS JOIN nation", right="nation")
add("join_two_keys", "lineitem", [("join", {"leftKeys": ["l_suppkey", "l_linenumber"], "rightKeys": ["s_suppkey", "s_nationkey"]}), select("l_orderkey", "l_partkey", "s_name")],
    "SELECT l_orderkey, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_linenumber = s_nationkey", right="supplier")
add("join_loose_keys", "orders", [gen("key", 'concat(o_custkey, "")'), ("join", {"leftKeys": ["key"], "rightKeys": ["c_custkey"]}), select("o_orderkey", "c_name")], "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", right="customer")


def join_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full self-join of a table, whose columns collide; rows without a left side fill the left columns."""
    doc = {
        "nodes": [{"id": "in", "type": "input"}, {"id": "low", "type": "filterRows", "config": {"expression": "n_nationkey < 15"}}, {"id": "high", "type": "filterRows", "config": {"expression": "n_nationkey >= 10"}},
                  {"id": "met", "type": "join", "config": {"joinType": "full", "leftKeys": ["n_nationkey"], "rightKeys": ["n_nationkey"], "rightPrefix": "r_"}}],
        "edges": [{"from": "in", "to": "low"}, {"from": "in", "to": "high"}, {"from": "low", "to": "met"}, {"from": "high", "to": "met", "toPort": "right"}],
    }
    return run(doc, {"in": table(spark, sf_dir, "nation")})


QUERIES["join_collision"] = join_collision
ORACLE_SQL["join_collision"] = """WITH l AS (SELECT * FROM nation WHERE n_nationkey < 15), r AS (SELECT * FROM nation WHERE n_nationkey >= 10)
SELECT coalesce(l.n_nationkey, r.n_nationkey) AS n_nationkey, coalesce(l.n_name, r.n_name) AS n_name, coalesce(l.n_regionkey, r.n_regionkey) AS n_regionkey,
  CASE WHEN l.n_name IS NOT NULL THEN r.n_nationkey END AS r_n_nationkey, CASE WHEN l.n_name IS NOT NULL THEN r.n_name END AS r_n_name, CASE WHEN l.n_name IS NOT NULL THEN r.n_regionkey END AS r_n_regionkey
FROM l FULL JOIN r ON l.n_nationkey = r.n_nationkey"""
add("lookup_last", "customer", [("lookupEnrich", {"key": "c_custkey", "referenceKey": "o_custkey", "fields": ["o_totalprice", "o_orderstatus"], "orderBy": ["o_orderdate", "o_orderkey"]}), select("c_custkey", "o_totalprice", "o_orderstatus")],
    "SELECT c_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", reference="orders")
add("union_by_name", "customer", [("union", {})], "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier", b="supplier")
add("union_distinct", "orders", [select("o_custkey", "o_orderstatus"), ("renameColumns", {"mapping": {"o_custkey": "c_custkey"}}), ("union", {"distinct": True}), select("c_custkey", "o_orderstatus"), ("deduplicate", {})],
    "SELECT c_custkey, o_orderstatus FROM (SELECT o_custkey AS c_custkey, o_orderstatus FROM orders UNION BY NAME SELECT * FROM customer) GROUP BY ALL", b="customer")

# Grouping, reshaping
AGGS = [{"column": "l_extendedprice", "func": f, "as": f} for f in ("sum", "avg", "min", "max", "count")]
add("group_all_functions", "lineitem", [("groupByAggregate", {"keys": ["l_returnflag", "l_linestatus"], "aggregations": AGGS})],
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS count FROM lineitem GROUP BY ALL", rounding(sum=2, avg=4))
add("group_global_text", "part", [("groupByAggregate", {"aggregations": [{"column": "p_name", "func": "sum", "as": "s"}, {"column": "p_name", "func": "max", "as": "m"}, {"column": "p_name", "func": "count", "as": "n"}]})], "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS m, count(*) AS n FROM part")
add("group_null_key", "events", [gen("k", 'if(user_id % 2 == 0, nothing, event_type)'), ("groupByAggregate", {"keys": ["k"], "aggregations": [{"column": "value", "func": "count", "as": "n"}]})], "SELECT CASE WHEN user_id % 2 <> 0 THEN event_type END AS k, count(*) AS n FROM events GROUP BY ALL")
add("group_first_last", "events", [("groupByAggregate", {"keys": ["user_id"], "orderBy": ["ts"], "aggregations": [{"column": "event_type", "func": "first", "as": "f"}, {"column": "value", "func": "last", "as": "l"}]})], "SELECT user_id, min_by(event_type, ts) AS f, max_by(value, ts) AS l FROM events GROUP BY user_id")
add("dedup_keys", "lineitem", [("deduplicate", {"keys": ["l_orderkey", "l_linenumber"], "orderBy": ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]}), select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")],
    "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1")
add("dedup_rows", "documents", [select("text"), ("deduplicate", {})], "SELECT DISTINCT text FROM documents")
PIVOT = {"indexColumn": "o_orderpriority", "pivotColumn": "o_orderstatus", "valueColumn": "o_totalprice"}
add("pivot_sum", "orders", [("filterRows", {"expression": 'o_orderstatus != "P" || o_totalprice > 400000'}), ("pivot", PIVOT | {"aggFunc": "sum", "values": ["F", "O", "P"]})],
    "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS {s}" for s in "FOP") + " FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 400000 GROUP BY 1", rounding(F=2, O=2, P=2))
add("pivot_count", "events", [("pivot", {"indexColumn": "user_id", "pivotColumn": "event_type", "valueColumn": "value", "aggFunc": "count", "values": ["error", "nothing"]}), select("user_id", "error", "nothing")],
    "SELECT user_id, nullif(count(*) FILTER (event_type = 'error'), 0) AS error, NULL::BIGINT AS nothing FROM events GROUP BY user_id")
add("pivot_first", "orders", [("pivot", PIVOT | {"orderBy": ["o_orderdate", "o_orderkey"]})], "SELECT o_orderpriority, " + ", ".join(f"min_by(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
add("unpivot", "lineitem", [("unpivot", {"idColumns": ["l_orderkey", "l_partkey"], "valueColumns": ["l_quantity", "l_tax"], "nameField": "what", "valueField": "v"})],
    "SELECT l_orderkey, l_partkey, 'l_quantity' AS what, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', l_tax FROM lineitem")
add("unpivot_mixed", "part", [("unpivot", {"idColumns": ["p_partkey"], "valueColumns": ["p_name", "p_size", "nothing"]})],
    "SELECT p_partkey, 'p_name' AS variable, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'nothing', NULL FROM part")

# Order, samples
TOP = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
add("sort_top", "lineitem", [("sort", {"keys": [{"column": c, "desc": c == TOP[0]} for c in TOP]}), ("sampling", {"size": 100, "method": "first"}), select(*TOP)], f"SELECT {', '.join(TOP)} FROM lineitem ORDER BY {TOP[0]} DESC, {', '.join(TOP[1:])} LIMIT 100")
add("sort_number_texts", "part", [gen("s", 'concat(p_size, "")'), ("sort", {"keys": [{"column": "s", "desc": True}, {"column": "p_partkey"}]}), ("sampling", {"size": 50}), select("p_partkey", "s")], "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s FROM part ORDER BY p_size DESC, p_partkey LIMIT 50")
add("sample_systematic", "orders", [("sampling", {"size": 700, "method": "systematic", "orderBy": ["o_orderkey"]}), select("o_orderkey", "o_totalprice")],
    "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(count(*) OVER () // 700, 1) AS step FROM orders) SELECT o_orderkey, o_totalprice FROM r WHERE i % step = 0 AND i // step < 700")
add("sample_random_size", "orders", [("sampling", {"size": 500, "method": "random", "seed": 7}), ("groupByAggregate", {"aggregations": [{"column": "o_orderkey", "func": "count", "as": "n"}]})], "SELECT least(count(*), 500) AS n FROM orders")


def pipeline_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with two joins, an enrichment, a branch and its reunion."""
    doc = {
        "nodes": [
            {"id": "orders", "type": "input"}, {"id": "customer", "type": "input"}, {"id": "nation", "type": "input"}, {"id": "lineitem", "type": "input"},
            {"id": "oc", "type": "join", "config": {"leftKeys": ["o_custkey"], "rightKeys": ["c_custkey"]}}, {"id": "named", "type": "lookupEnrich", "config": {"key": "c_nationkey", "referenceKey": "n_nationkey", "fields": ["n_name"]}},
            {"id": "lines", "type": "join", "config": {"leftKeys": ["l_orderkey"], "rightKeys": ["o_orderkey"]}}, {"id": "rev", "type": "generateColumn", "config": {"column": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}},
            {"id": "big", "type": "filterRows", "config": {"expression": "l_quantity >= 30"}}, {"id": "small", "type": "filterRows", "config": {"expression": "l_quantity < 10"}}, {"id": "off", "type": "sampling", "config": {"size": 1}, "disabled": True},
            {"id": "sum", "type": "groupByAggregate", "config": {"keys": ["n_name", "c_mktsegment"], "aggregations": [{"column": "revenue", "func": "sum", "as": "revenue"}, {"column": "revenue", "func": "count", "as": "n"}]}}, {"id": "out", "type": "output"},
        ],
        "edges": [
            {"from": "orders", "to": "oc"}, {"from": "customer", "to": "oc", "toPort": "right"}, {"from": "oc", "to": "named"}, {"from": "nation", "to": "named", "toPort": "reference"}, {"from": "lineitem", "to": "lines"}, {"from": "named", "to": "lines", "toPort": "right"},
            {"from": "lines", "to": "rev"}, {"from": "rev", "to": "big"}, {"from": "rev", "to": "small"}, {"from": "big", "to": "off"}, {"from": "off", "to": "sum"}, {"from": "small", "to": "sum"}, {"from": "sum", "to": "out"},
        ],
    }
    return run(doc, {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem")}).withColumn("revenue", F.round("revenue", 2))


QUERIES["pipeline_star"] = pipeline_star
ORACLE_SQL["pipeline_star"] = """SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 30 OR l_quantity < 10 GROUP BY ALL"""


# Profiles, quality
def profile_sql(name: str, columns: dict[str, str]) -> str:
    """`columns`: the inferred type of each column."""
    each = []
    for c, t in columns.items():
        low, high = (f"CAST({f}({c}) AS VARCHAR)" for f in ("min", "max"))
        pattern = f"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '[0-9]', '9', 'g'), '[a-zA-Z]', 'A', 'g')"
        mode = f"(SELECT p FROM (SELECT {pattern} AS p, count(*) AS n FROM {name} WHERE strlen(CAST({c} AS VARCHAR)) <= 32 GROUP BY 1 ORDER BY n DESC, p LIMIT 1))"
        each.append(f"""SELECT '{c}' AS "column", '{t}' AS inferred_type, count(*) AS row_count, CAST(0 AS BIGINT) AS null_count, 0.0::DOUBLE AS null_rate, count(DISTINCT {c}) AS distinct_count, round((count(*) - count(DISTINCT {c})) / count(*), 6) AS duplicate_rate,
        {low} AS min, {high} AS max, round(avg(strlen(CAST({c} AS VARCHAR))), 4) AS mean_length, {mode} AS format_pattern FROM {name}""")
    return " UNION ALL ".join(each)


def profiled(name: str, columns: dict[str, str]) -> None:
    QUERIES[f"profile_{name}"] = lambda spark, sf_dir: profiles.profile(table(spark, sf_dir, name).select(*columns)).withColumns({"duplicate_rate": F.round("duplicate_rate", 6), "mean_length": F.round("mean_length", 4)})
    ORACLE_SQL[f"profile_{name}"] = profile_sql(name, columns)


profiled("customer", {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_mktsegment": "string"})
profiled("part", {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer"})
profiled("events", {"event_id": "integer", "user_id": "integer", "event_type": "string", "props": "string"})

EXPECTED = [
    profiles.Expected("p_name", "string", unique=True),
    profiles.Expected("size", "integer", pattern="99", constraints=[("min", "5"), ("max", "45")]),
    profiles.Expected("p_brand", "string", constraints=[("enum", "Brand#1, Brand#2, Brand#3")]),
]


def defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = chain(gen("size", 'if(p_partkey % 10 == 0, nothing, if(p_partkey % 9 == 0, "big", concat(p_size, "")))'))
    return run(doc, {"in": table(spark, sf_dir, "part")})


def quality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.quality(defective(spark, sf_dir), EXPECTED)
    return found.select("column", "filled", "invalid", *(F.round(d, 6).alias(d) for d in profiles.DIMENSIONS))


def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.overall(profiles.quality(defective(spark, sf_dir), EXPECTED))
    return found.select(*(F.round(d, 6).alias(d) for d in (*profiles.DIMENSIONS, "overall")))


QUALITY_SQL = """WITH d AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN 'big' ELSE CAST(p_size AS VARCHAR) END AS size FROM part),
c AS (SELECT count(*) AS t, count(size) AS f, count(*) FILTER (size = 'big') AS bad, count(*) FILTER (size IS NOT NULL AND NOT regexp_matches(size, '^[0-9][0-9]$')) AS off,
  count(*) FILTER (size IS NOT NULL AND NOT coalesce(TRY_CAST(size AS DOUBLE) >= 5, false)) AS lo, count(*) FILTER (size IS NOT NULL AND NOT coalesce(TRY_CAST(size AS DOUBLE) <= 45, false)) AS hi, count(DISTINCT p_name) AS names,
  count(*) FILTER (p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')) AS brands FROM d),
q AS (SELECT 'p_name' AS "column", t AS filled, 0::BIGINT AS invalid, 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS validity, names / t AS uniqueness, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS accuracy FROM c
  UNION ALL SELECT 'size', f, bad, f / t, 1 - bad / f, 1, 1 - off / f, greatest(0, 1 - bad / f - lo / f - hi / f) FROM c
  UNION ALL SELECT 'p_brand', t, 0, 1, 1, 1, 1, 1 - brands / t FROM c)
"""
QUERIES["quality_columns"], QUERIES["quality_overall"] = quality_columns, quality_overall
ORACLE_SQL["quality_columns"] = QUALITY_SQL + 'SELECT "column", filled, invalid, ' + ", ".join(f"round({d}, 6) AS {d}" for d in profiles.DIMENSIONS) + " FROM q"
ORACLE_SQL["quality_overall"] = QUALITY_SQL + "SELECT " + ", ".join(f"round(avg({d}), 6) AS {d}" for d in profiles.DIMENSIONS) + ", round(0.2 * (" + " + ".join(f"avg({d})" for d in profiles.DIMENSIONS) + "), 6) AS overall FROM q"


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.repeated_rows(table(spark, sf_dir, "documents").select("text"))


QUERIES["repeated_rows"] = repeated_rows
ORACLE_SQL["repeated_rows"] = """SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS repeats, CASE WHEN (count(*) - count(DISTINCT text)) * 100.0 / count(*) >= 1 THEN printf('duplicate rows detected: %.1f%%', (count(*) - count(DISTINCT text)) * 100.0 / count(*)) END AS warning FROM documents"""


# Exports: a row for each line of the document
def exported(name: str, source: str, sql: str, **options: Any) -> None:
    QUERIES[f"export_{name}"] = lambda spark, sf_dir: export_lines(table(spark, sf_dir, source).orderBy(*options.get("columns", ["r_regionkey"])[:1]), name, **options)
    ORACLE_SQL[f"export_{name}"] = sql


exported("csv", "nation", "SELECT 'n_nationkey;n_name' AS line UNION ALL SELECT n_nationkey || ';' || n_name FROM nation", columns=["n_nationkey", "n_name"], delimiter=";")
exported("markdown", "nation", "SELECT '| n_nationkey | n_name |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation", columns=["n_nationkey", "n_name"])
exported("yaml", "supplier", "SELECT '-' || chr(10) || '  s_suppkey: ' || s_suppkey || chr(10) || '  s_name: \"' || s_name || '\"' AS line FROM supplier", columns=["s_suppkey", "s_name"])
exported("xml", "nation", "SELECT '<rows>' AS line UNION ALL SELECT '  <row>' || chr(10) || '    <n_nationkey>' || n_nationkey || '</n_nationkey>' || chr(10) || '    <n_name>' || n_name || '</n_name>' || chr(10) || '  </row>' FROM nation UNION ALL SELECT '</rows>'", columns=["n_nationkey", "n_name"])
exported("json", "region", "SELECT '[' AS line UNION ALL SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || CASE WHEN r_regionkey = (SELECT max(r_regionkey) FROM region) THEN '' ELSE ',' END FROM region UNION ALL SELECT ']'")
exported("sql", "customer", """WITH c AS (SELECT c_custkey, '  (' || c_custkey || ', ''' || c_name || ''')' AS r, (row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS b FROM customer)
SELECT 'INSERT INTO t ("c_custkey", "c_name") VALUES' || chr(10) || string_agg(r, ',' || chr(10) ORDER BY c_custkey) || ';' AS line FROM c GROUP BY b""", columns=["c_custkey", "c_name"], table="t")  # fmt: skip


# Operating hours, run times
def open_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", extras.in_hours(F.col("ts"), {"monday": (540, 1020), "saturday": (600, 720)}).alias("open"))


QUERIES["operating_hours"] = open_hours
ORACLE_SQL["operating_hours"] = """SELECT event_id, (isodow(ts) = 1 AND hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 1020) OR (isodow(ts) = 6 AND hour(ts) * 60 + minute(ts) >= 600 AND hour(ts) * 60 + minute(ts) < 720) AS "open" FROM events"""
QUERIES["expected_seconds"] = lambda spark, sf_dir: extras.expected_seconds(table(spark, sf_dir, "events"), "event_type", "ts", "value").withColumn("expected_seconds", F.round("expected_seconds", 4))
ORACLE_SQL["expected_seconds"] = "SELECT event_type, round(avg(value), 4) AS expected_seconds FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 10) GROUP BY event_type"


# Sources: what is written is read back
def read_back(name: str, source: str, columns: list[str], save: Callable[[DataFrame, str], None], load: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_dir(spark, name)}/{name}"
        save(table(spark, sf_dir, source).select(*columns), path)
        return load(spark, path)

    QUERIES[name], ORACLE_SQL[name] = query, sql


def spelled(*columns_: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns_)


one_file = lambda df: df.coalesce(1)
#: Spark's CSV writer would trim the texts.
WHOLE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_quoted(df: DataFrame, path: str) -> None:
    """CSV with all fields in quotes, where null and empty texts are alike, so that a column tells which are null."""
    df.withColumn("missing", F.col("text").isNull()).write.csv(path, header=True, escape='"', quoteAll=True, lineSep="\n", **WHOLE)


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    rows = files.read_csv(spark, path, preserve_empty=True, keep_returns=True)
    return rows.select(F.nullif("doc_id", F.lit("")).alias("doc_id"), F.when(F.col("missing") == "false", F.sha2("text", 256)).alias("text"))


read_back("source_csv", "nation", ["n_nationkey", "n_name", "n_regionkey"], lambda df, path: write(one_file(df), path, "csv"), lambda spark, path: files.read_csv(spark, path), f"SELECT {spelled('n_nationkey', 'n_name', 'n_regionkey')} FROM nation")
read_back("source_csv_quoted", "documents", ["doc_id", "text"], write_quoted, read_quoted, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text FROM documents")
read_back("source_tsv_detected", "customer", ["c_custkey", "c_name", "c_mktsegment"], lambda df, path: df.write.csv(path, header=True, sep="\t", **WHOLE), lambda spark, path: files.read(spark, path, "csv"), f"SELECT {spelled('c_custkey', 'c_name', 'c_mktsegment')} FROM customer")
read_back("source_csv_headerless", "supplier", ["s_suppkey", "s_name"], lambda df, path: df.write.csv(path, sep="|", **WHOLE), lambda spark, path: files.read_csv(spark, path, delimiter="|", header=False), "SELECT CAST(s_suppkey AS VARCHAR) AS column_1, s_name AS column_2 FROM supplier")
read_back("source_ndjson", "events", ["event_id", "event_type", "value"], lambda df, path: df.write.json(path), lambda spark, path: files.read_ndjson(spark, path, "event_id long, event_type string, value double"), "SELECT event_id, event_type, value FROM events")
read_back("source_json_envelope", "nation", ["n_nationkey", "n_name"], lambda df, path: one_file(df.agg(F.collect_list(F.struct(*map(column, df.columns))).alias("items"), F.count(F.lit(1)).alias("count"))).write.json(path), lambda spark, path: files.read_json(spark, path), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
read_back("source_json_array", "region", ["r_regionkey", "r_name"], lambda df, path: one_file(export_lines(df, "json")).write.text(path), lambda spark, path: files.read_json(spark, path, "r_regionkey long, r_name string"), "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
read_back("source_orc", "part", ["p_partkey", "p_name", "p_retailprice"], lambda df, path: df.write.orc(path + ".orc"), lambda spark, path: files.read(spark, path + ".orc"), "SELECT p_partkey, p_name, p_retailprice FROM part")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats told from names and first lines."""
    cases = [("x.csv", "a,b"), ("x.tsv", "a\tb"), ("x.json", "[1]"), ("x.ndjson", '{"a": 1}'), ("x.jsonl", "{}"), ("x.txt", "a;b"), ("x", '{"a": 1}\n{"a": 2}'), ("x", "[1, 2]"), ("x", "a|b\n1|2"), ("x.parquet", ""), ("x.orc", "")]
    return spark.createDataFrame([(i, files.detect_format(p, t.split("\n")), files.detect_delimiter(t.split("\n"))) for i, (p, t) in enumerate(cases)], "i long, format string, delimiter string")


QUERIES["source_detection"] = detected
ORACLE_SQL["source_detection"] = "SELECT CAST(i AS BIGINT) AS i, format, delimiter FROM (VALUES (0, 'csv', ','), (1, 'csv', chr(9)), (2, 'json', ','), (3, 'ndjson', ','), (4, 'ndjson', ','), (5, 'csv', ';'), (6, 'ndjson', ','), (7, 'json', ','), (8, 'csv', '|'), (9, 'parquet', ','), (10, 'orc', ',')) t(i, format, delimiter)"

# What had no query: `<=`, now, random samples by content, issues, sample values
add("filter_at_most", "lineitem", [("filterRows", {"expression": "l_quantity <= 10 && l_tax <= l_discount"}), select("l_orderkey", "l_partkey", "l_linenumber")], "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_tax <= l_discount")
add("formula_now", "region", [gen("y", "year(substr(now(), 0, 10)) >= 2024"), gen("n", "len(substr(now(), 0, 10))"), select("r_regionkey", "y", "n")], "SELECT r_regionkey, true AS y, 10.0::DOUBLE AS n FROM region")
add("fill_several", "customer", [gen("a", NULLED[0]), gen("b", "if(c_custkey % 3 == 0, nothing, c_custkey)"), ("fillMissingValues", {"fills": {"a": None, "b": None}, "strategy": "mean"}), select("c_custkey", "a", "b")],
    f"WITH x AS (SELECT c_custkey, {NULLED[1]} AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS b FROM customer) SELECT c_custkey, round(coalesce(a, (SELECT avg(a) FROM x)), 4) AS a, round(coalesce(b, (SELECT avg(b) FROM x)), 4) AS b FROM x", rounding(a=4, b=4))


def sample_random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a random sample: its size, its different keys, those that the table has with equal values, and whether it keeps the table's order."""
    orders = table(spark, sf_dir, "orders")
    one = run(chain(("sampling", {"size": 400, "method": "random", "seed": 3})), {"in": orders})
    known = one.withColumn("at", F.monotonically_increasing_id()).join(orders.withColumnRenamed("o_totalprice", "p"), "o_orderkey")
    return known.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum((F.col("o_totalprice") == F.col("p")).cast("long")).alias("equal"), (F.corr("at", "o_orderkey") > 0.5).alias("in_order"))


QUERIES["sample_random_rows"] = sample_random_rows
ORACLE_SQL["sample_random_rows"] = "SELECT least(count(*), 400) AS n, least(count(*), 400) AS keys, CAST(least(count(*), 400) AS BIGINT) AS equal, true AS in_order FROM orders"


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.issues(profiles.quality(defective(spark, sf_dir), EXPECTED), EXPECTED).withColumn("affected_pct", F.round("affected_pct", 4))


QUERIES["quality_issues"] = quality_issues
ORACLE_SQL["quality_issues"] = QUALITY_SQL.rstrip().removesuffix("\n") + """,
i AS (SELECT 'size' AS "column", 'accuracy' AS dimension, CAST(lo AS BIGINT) AS n, f AS total, ' values violate constraint min 5' AS said FROM c
  UNION ALL SELECT 'size', 'accuracy', hi, f, ' values violate constraint max 45' FROM c UNION ALL SELECT 'size', 'completeness', t - f, t, ' missing values' FROM c
  UNION ALL SELECT 'size', 'validity', bad, f, ' values don''t match inferred type integer' FROM c UNION ALL SELECT 'p_brand', 'accuracy', brands, t, ' values violate constraint enum Brand#1, Brand#2, Brand#3' FROM c
  UNION ALL SELECT 'p_name', 'uniqueness', t - names, t, ' duplicate values in a column marked unique' FROM c)
SELECT "column", dimension, n || said AS message, CASE WHEN n / total >= 0.25 THEN 'critical' WHEN n / total >= 0.05 THEN 'warning' ELSE 'info' END AS severity, round(100 * n / total, 4) AS affected_pct FROM i WHERE n > 0"""
QUERIES["sample_values"] = lambda spark, sf_dir: profiles.sample_values(table(spark, sf_dir, "region"), "r_name", 10)
ORACLE_SQL["sample_values"] = "SELECT r_name AS value FROM region"

# JSON documents in ranges, formats told from what was written, profiles merged from parts, both ports of nodes in one pass
read_back("source_json_documents", "documents", ["doc_id", "text"], lambda df, path: write(df, path, "json", documents=True), lambda spark, path: files.read_json(spark, path, "doc_id long, text string").withColumn("text", F.sha2("text", 256)), "SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(text) AS text FROM documents")


def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in five ways under names that tell nothing, each told from its lines and read back."""
    nation, folder = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), work_dir(spark, "formats")
    one_file(nation).write.csv(f"{folder}/a", header=True, sep="|")
    one_file(nation).write.csv(f"{folder}/b", header=True, sep="\t")
    one_file(nation).write.json(f"{folder}/c")
    one_file(export_lines(nation, "json")).write.text(f"{folder}/d")
    nation.write.parquet(f"{folder}/e.parquet")
    found = None
    for name in ("a", "b", "c", "d", "e.parquet"):
        path = f"{folder}/{name}"
        rows = files.read(spark, path).select(F.lit(name[0]).alias("file"), F.lit(files.told(spark, path)).alias("format"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        found = rows if found is None else found.unionByName(rows)
    return found


QUERIES["source_formats"] = source_formats
ORACLE_SQL["source_formats"] = "SELECT file, format, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation CROSS JOIN (VALUES ('a', 'csv'), ('b', 'csv'), ('c', 'ndjson'), ('d', 'json'), ('e', 'parquet')) f(file, format)"
SKETCHED = {"o_orderkey": "integer", "o_orderstatus": "string", "o_orderpriority": "string", "o_custkey": "integer"}


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of a profile that is merged from the states of two parts of a table."""
    orders = table(spark, sf_dir, "orders").select(*SKETCHED)
    parts = [sketches.states(orders.filter(F.col("o_orderkey") % 3 == 0)), sketches.states(orders.filter(F.col("o_orderkey") % 3 != 0))]
    return sketches.estimates(sketches.merged(*parts)).select("column", "inferred_type", "row_count", "null_count", "min", "max", F.round("mean_length", 4).alias("mean_length"), "format_pattern")


QUERIES["profile_merged"] = profile_merged
ORACLE_SQL["profile_merged"] = f'SELECT "column", inferred_type, row_count, null_count, min, max, mean_length, format_pattern FROM ({profile_sql("orders", SKETCHED)})'


def both_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a filter that fails for some rows: those that go on and those that failed, from one pass, counted by line number."""
    count = lambda column: ("groupByAggregate", {"keys": ["l_linenumber", "port"], "aggregations": [{"column": column, "func": "count", "as": "n"}]})
    nodes = {
        "in": ("input", {}), "filter": ("filterRows", {"expression": "100 % (l_linenumber - 2) >= 0"}), "good": gen("port", '"rows"'), "bad": gen("port", '"errors"'),
        "flat": ("flattenJSON", {"column": "row"}), "named": ("renameColumns", {"mapping": {"row.l_linenumber": "l_linenumber"}}), "rows": count("l_orderkey"), "errors": count("message"), "all": ("union", {}), "out": ("output", {}),
    }
    links = [("in", "filter"), ("filter", "good"), ("good", "rows"), ("rows", "all"), ("bad", "flat"), ("flat", "named"), ("named", "errors"), ("all", "out")]
    edges = [{"from": a, "to": b} for a, b in links] + [{"from": "filter", "fromPort": "errors", "to": "bad"}, {"from": "errors", "to": "all", "toPort": "b"}]
    document = {"nodes": [{"id": i, "type": t, "config": c} for i, (t, c) in nodes.items()], "edges": edges}
    return run(document, {"in": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")})


QUERIES["both_ports"] = both_ports
ORACLE_SQL["both_ports"] = "SELECT l_linenumber, CASE WHEN l_linenumber = 2 THEN 'errors' ELSE 'rows' END AS port, count(*) AS n FROM lineitem GROUP BY ALL"

# Samples without a write or a single task, duplicates that lie near each other
add("sample_systematic_scan", "orders", [("sampling", {"size": 700, "method": "systematic"}), select("o_orderkey", "o_totalprice")],
    "WITH r AS (SELECT *, row_number() OVER () - 1 AS i, greatest(count(*) OVER () // 700, 1) AS step FROM orders) SELECT o_orderkey, o_totalprice FROM r WHERE i % step = 0 AND i // step < 700")
add("sample_random_most", "lineitem", [("sampling", {"size": 5000, "method": "random", "seed": 11}), ("groupByAggregate", {"aggregations": [{"column": "l_orderkey", "func": "count", "as": "n"}]})], "SELECT least(count(*), 5000) AS n FROM lineitem")
add("dedup_near", "events", [("deduplicate", {"keys": ["user_id", "event_type"], "orderBy": ["ts", "event_id"], "within": ["ts", "2 hours"]}), select("event_id", "user_id", "event_type")],
    "SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 2 HOUR")
