"""Nodes over nulls, ties, missing columns and wrong configurations; graphs; streams."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftflow.functions import extras
from weftflow.operators import AnalysisError, Inputs, NODES, node, types
from weftflow.operators.ordinal import with_ordinal
from weftflow.plans import jobs
from weftflow.plans import profile as profiles
from weftflow.plans.pipeline import Pipeline, run
from weftflow.streaming.pipelines import bind_stream


def apply(kind, df, config=None, ports=None, on_error="skip"):
    return NODES[kind](Inputs(df, ports or {}, config or {}, on_error))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_types():
    assert len(types()) >= 22 and "join" in types()


def test_filter_of_texts_that_are_numbers(spark):
    df = spark.createDataFrame([("20",), ("10",), (None,), ("abc",)], "age string")
    assert rows(apply("filterRows", df, {"expression": "age > 18"}).df) == [("20",), ("abc",)]


def test_join_null_keys_and_collisions(spark):
    l = spark.createDataFrame([(1, "l1"), (2, "l2"), (None, "l3")], "id int, v string")
    r = spark.createDataFrame([(1, "r1"), (None, "rn"), (9, "r9")], "id int, v string")
    config = {"leftKeys": ["id"], "rightKeys": ["id"]}
    assert rows(apply("join", l, config, {"right": r}).df) == rows(spark.createDataFrame([(1, "l1", 1, "r1"), (None, "l3", None, "rn")], "a int, b string, c int, d string"))
    full = rows(apply("join", l, config | {"joinType": "full"}, {"right": r}).df)
    assert (9, "r9", None, None) in full and (2, "l2", None, None) in full and len(full) == 4
    with pytest.raises(AnalysisError):
        apply("join", l, config | {"joinType": "sideways"}, {"right": r})
    with pytest.raises(AnalysisError):
        apply("join", l, config)
    assert apply("join", l, {}, {"right": r}).df.count() == 9


def test_lookup_keeps_what_it_misses(spark):
    main = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "k string, f string")
    ref = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), (None, "n", 1)], "k string, f string, at int")
    assert rows(apply("lookupEnrich", main, {"key": "k", "fields": ["f"], "orderBy": ["at"]}, {"reference": ref}).df) == [("a", "2"), ("b", "old"), (None, "n")]


def test_first_last_with_null_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y")], "o int, k string, v string")
    aggs = [{"column": "v", "func": "first"}, {"column": "v", "func": "last"}, {"column": "nosuch", "func": "sum"}]
    got = apply("groupByAggregate", df, {"keys": ["k"], "aggregations": aggs, "orderBy": ["o"]}).df
    assert got.columns == ["k", "first_v", "last_v", "sum_nosuch"] and rows(got) == [("a", None, "x", 0.0), ("b", "y", "y", 0.0)]
    assert apply("groupByAggregate", df.limit(0), {"aggregations": aggs[2:]}).df.count() == 0
    with pytest.raises(AnalysisError):
        apply("groupByAggregate", df, {"aggregations": [{"column": "v", "func": "median"}]})


def test_deduplicate(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "o int, k string")
    assert rows(apply("deduplicate", df, {"keys": ["k"], "orderBy": ["o"]}).df) == [(1, "a"), (3, None)]
    once = apply("deduplicate", df).df
    assert rows(apply("deduplicate", once).df) == rows(once)


def test_pivot(spark):
    df = spark.createDataFrame([("i", "p", 1.0), ("i", None, 2.0), ("j", "q", 3.0), ("i", "p", 4.0)], "i string, p string, v double")
    got = apply("pivot", df, {"indexColumn": "i", "pivotColumn": "p", "valueColumn": "v", "aggFunc": "sum"}).df
    assert got.columns == ["i", "<nil>", "p", "q"] and rows(got) == [("i", 2.0, 5.0, None), ("j", None, None, 3.0)]
    assert apply("pivot", df, {}).df is df


def test_unpivot_back(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 4.0)], "i int, x double, y double")
    long = apply("unpivot", df, {"idColumns": ["i"], "valueColumns": ["x", "y"]}).df
    assert long.count() == 4
    assert rows(apply("pivot", long, {"indexColumn": "i", "pivotColumn": "variable", "valueColumn": "value", "orderBy": ["value"]}).df) == rows(df)


def test_casts(spark):
    df = spark.createDataFrame([("3.9",), ("-3.9",), ("",), (None,), ("yes",), ("T",), ("12abc",)], "x string")
    found = apply("typeCast", df, {"casts": {"x": "integer", "y": "integer", "z": "date"}})
    assert [r[0] for r in found.df.collect()] == [3, -3, None, None, None, None, None] and found.df.columns == ["x", "y", "z"]
    assert sorted(r.message for r in found.errors.collect())[0] == 'typeCast: cannot cast "" to integer' and found.errors.count() == 4
    assert [r[0] for r in apply("typeCast", df, {"casts": {"x": "boolean"}}).df.collect()][4:6] == [None, True]
    with pytest.raises(Exception, match="cannot cast"):
        apply("typeCast", df, {"casts": {"x": "integer"}}, on_error="stop").df.collect()


def test_row_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    made = apply("generateColumn", df, {"column": "c", "expression": "a / b"})
    assert rows(made.df) == [(1.0, 0.0, None), (4.0, 2.0, 2.0)] and made.errors.first() == Row(row=Row(a=1.0, b=0.0), message="expression: division by zero")
    assert rows(apply("generateColumn", df, {"column": "a", "expression": "a / b"}).df) == [(1.0, 0.0), (2.0, 2.0)]
    assert rows(apply("filterRows", df, {"expression": "a / b > 1"}).df) == [(4.0, 2.0)]
    with pytest.raises(Exception, match="division by zero"):
        apply("filterRows", df, {"expression": "a / b > 1"}, on_error="stop").df.collect()


def test_texts(spark):
    df = spark.createDataFrame([("foo-BAR baz_q",), ("",), ("éa",), (None,)], "s string")
    assert [r[0] for r in apply("stringTransform", df, {"column": "s", "operation": "title"}).df.collect()] == ["Foo-Bar Baz_q", "", "Éa", None]
    assert [r[0] for r in apply("stringTransform", df, {"column": "s", "operation": "capitalize"}).df.collect()] == ["Foo-BAR baz_q", "", "Éa", None]
    assert apply("stringTransform", df, {"column": "s", "operation": "nosuch"}).df is df
    parts = apply("splitColumn", spark.createDataFrame([("a. b .c",), (None,)], "s string"), {"column": "s", "delimiter": ".", "targetColumns": ["x", "y"]}).df
    assert rows(parts) == [("a. b .c", "a", "b"), (None, None, None)]
    with pytest.raises(AnalysisError):
        apply("regexExtract", df, {"column": "s", "pattern": "(?=a)"})
    with pytest.raises(AnalysisError):
        apply("regexExtract", df, {"column": "s", "pattern": "("})


def test_validation(spark):
    df = spark.createDataFrame([("5", "a"), ("x", "a"), (None, "b"), ("7", "")], "n string, e string")
    found = apply("validateSchema", df, {"rules": [{"column": "n", "kind": "min", "value": "5"}, {"column": "e", "kind": "enum", "value": "a, c"}]})
    assert rows(found.df) == [("5", "a")]
    assert sorted(r.message for r in found.errors.collect()) == ['validateSchema: column "e" failed rule "enum"', *['validateSchema: column "n" failed rule "min"'] * 2]


def test_flatten(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": {"c": "x", "d": [1, 2]}}), (2, None)], "i int, j struct<a:int,b:struct<c:string,d:array<int>>>")
    got = apply("flattenJSON", df, {"column": "j"}).df
    assert got.columns == ["i", "j.a", "j.b.c", "j.b.d"] and rows(got) == [(1, 1, "x", [1, 2]), (2, None, None, None)]
    assert apply("flattenJSON", spark.createDataFrame([({"k": 1},)], "m map<string,int>"), {"column": "m", "separator": "_"}).df.columns == ["m_k"]


def test_fills(spark):
    df = spark.createDataFrame([("1",), ("3",), ("",), (None,), ("x",)], "s string")
    assert [r[0] for r in apply("fillMissingValues", df, {"fills": {"s": None}, "strategy": "mean"}).df.collect()] == ["1", "3", "2", "2", "x"]
    assert [r[0] for r in apply("fillMissingValues", df, {"fills": {"s": "q"}}).df.collect()] == ["1", "3", "q", "q", "x"]
    assert apply("fillMissingValues", df.limit(0), {"fills": {"s": None}, "strategy": "mode"}).df.count() == 0


def test_ordinals(spark):
    df = spark.range(1000).withColumn("k", F.lit(1)).repartition(7)
    numbered, n = with_ordinal(df, ["id"], 5)
    assert n == 1000 and numbered.filter("id <> __i").count() == 0
    assert with_ordinal(df.limit(0), ["id"])[1] == 0


def test_sampling_sizes(spark):
    df = spark.range(10)
    assert apply("sampling", df, {"size": 0}).df is df and apply("sampling", df, {"size": "3"}).df is df
    assert apply("sampling", df, {"size": 3, "method": "random", "seed": 1}).df.count() == 3
    assert rows(apply("sampling", df, {"size": 4, "method": "systematic", "orderBy": ["id"]}).df) == [(0,), (2,), (4,), (6,)]
    assert apply("sampling", df, {"size": 99, "method": "systematic", "orderBy": ["id"]}).df.count() == 10


def test_graphs(spark):
    df = spark.createDataFrame([("30",), ("5",)], "age string")
    doc = {"nodes": [{"id": "a", "type": "input"}, {"id": "f", "type": "filterRows", "config": {"expression": "10 / (age - 5) > 0"}}, {"id": "out", "type": "output"}], "edges": [{"from": "a", "to": "f"}, {"from": "f", "to": "out"}]}
    assert rows(run(doc, {"a": df})) == [("30",)]
    bound = Pipeline.parse(doc).bind({"a": df}, observe=True)
    bound.output().count()
    assert bound.metrics("f") == {"rows": 1} and bound.errors["f"].count() == 1
    bad = {**doc, "edges": [*doc["edges"], {"from": "f", "fromPort": "errors", "to": "e"}], "nodes": [*doc["nodes"], {"id": "e", "type": "output"}]}
    assert Pipeline.parse(bad).bind({"a": df}).frames["e"].count() == 1
    with pytest.raises(AnalysisError, match="cycle"):
        Pipeline.parse({"nodes": [{"id": "a", "type": "sort"}, {"id": "b", "type": "sort"}], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]})
    for broken in ({"nodes": [{"id": "a", "type": "nosuch"}]}, {"nodes": [], "edges": [{"from": "x", "to": "y"}]}, {"nodes": [{"id": "a", "type": "input"}, {"id": "a", "type": "input"}]}):
        with pytest.raises(AnalysisError):
            Pipeline.parse(broken)
    with pytest.raises(AnalysisError, match="nothing is bound"):
        run(doc, {})


def test_own_nodes(spark):
    @node("double")
    def double(x):
        return x.main.select((F.col("id") * 2).alias("id"))

    assert rows(run({"nodes": [{"id": "a", "type": "input"}, {"id": "d", "type": "double"}], "edges": [{"from": "a", "to": "d"}]}, {"a": spark.range(2)})) == [(0,), (2,)]
    del NODES["double"]


def test_jobs(spark):
    done = jobs.submit(spark.range(5), lambda df: df.count()).wait(60)
    assert done.status == "completed" and done.result == 5
    assert jobs.submit(spark.range(5).select(F.raise_error(F.lit("no"))), lambda df: df.collect()).wait(60).status == "failed"


def test_jobs_are_held_and_cancelled(spark):
    steps = []
    job = jobs.submit(spark.range(3), lambda df: steps.append(df.count()), lambda df: steps.append(df.count() + 1), paused=True)
    job.wait(0.5)
    assert not steps and job.status == "paused"
    jobs.resume(job)
    assert job.wait(60).status == "completed" and steps == [3, 4] and job.done == 2
    slow = spark.range(8).repartition(8).select(F.call_function("java_method", F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(60_000).cast("long")).alias("x"))
    job = jobs.submit(slow, lambda df: df.collect(), paused=True)
    jobs.cancel(slow, job)
    assert job.wait(60).status == "cancelled" and job.done == 0


def test_counts_of_nodes(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    doc = {"nodes": [{"id": "a", "type": "input"}, {"id": "f", "type": "filterRows", "config": {"expression": "12 / n > 2"}}], "edges": [{"from": "a", "to": "f"}]}
    bound = Pipeline.parse(doc).bind({"a": df}, observe=True)
    bound.output().count()
    assert bound.counts("f") == {"rows_in": 10, "rows": 5} and bound.failed("f") == 1 and bound.failed("a") == 0


def test_fills_scan_once(spark, tmp_path, capsys):
    spark.createDataFrame([(1.0, None, "x"), (None, 4.0, ""), (3.0, 2.0, "x")], "a double, b double, c string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = apply("fillMissingValues", df, {"fills": {"a": None, "b": None}, "strategy": "mean"}).df
    assert sorted(rows(got), key=str) == sorted([(1.0, 3.0, "x"), (2.0, 4.0, ""), (3.0, 2.0, "x")], key=str)
    apply("fillMissingValues", df, {"fills": {"a": None, "b": None}, "strategy": "mean"}).df.explain("simple")
    assert capsys.readouterr().out.count("FileScan parquet") == 2  # one for the rows, one for the means
    assert [r.c for r in apply("fillMissingValues", df, {"fills": {"c": None}, "strategy": "mode"}).df.collect()] == ["x"] * 3


def test_reports(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "1")], "k string, v string")
    from weftflow.plans import profile as profiles

    found = profiles.report(df, 2).collect()
    assert [c["column"] for c in found["columns"]] == ["k", "v"] and len(found["sample"]) == 2 and len(found["warnings"]) == 2
    near = {c["column"]: c["distinct_count"] for c in profiles.report(df, 2, approximate=True).collect()["columns"]}
    assert near == {"k": 2, "v": 1}


def test_file_streams(spark, tmp_path):
    from weftflow.sources import files

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"id": 1}\nbroken\n\n{"id": 2}\n')
    for name, stream in (("c", files.stream_csv(spark, str(tmp_path / "csv"), ["id", "name"], preserve_empty=True)), ("j", files.stream_ndjson(spark, str(tmp_path / "json"), "id long"))):
        stream.writeStream.format("memory").queryName(f"files_{name}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    assert rows(spark.table("files_c")) == [("1", "x, y"), ("2", "")] and rows(spark.table("files_j")) == [(1,), (2,)]


def test_streams(spark, tmp_path):
    spark.range(20).select(F.col("id").cast("string").alias("age")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("age string").parquet(str(tmp_path / "in"))
    doc = {"nodes": [{"id": "a", "type": "input"}, {"id": "f", "type": "filterRows", "config": {"expression": "age >= 18"}}], "edges": [{"from": "a", "to": "f"}]}
    query = bind_stream(doc, {"a": stream}).writeStream.format("memory").queryName("grown").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert rows(spark.table("grown")) == [("18",), ("19",)]
    with pytest.raises(AnalysisError):
        bind_stream({"nodes": [{"id": "a", "type": "input"}, {"id": "f", "type": "sort"}], "edges": [{"from": "a", "to": "f"}]}, {"a": stream})


def test_secrets_and_hours(spark):
    df = spark.createDataFrame([("2024-01-06 10:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    key = F.lit("pass")
    assert df.select(extras.opened(extras.sealed(F.lit("secret"), key), key)).first()[0] == "secret"
    assert df.select(extras.opened(extras.sealed(F.lit("secret"), key), F.lit("other"))).first()[0] is None
    assert str(df.select(extras.next_opening(F.col("t"), {"monday": (540, 600)})).first()[0]) == "2024-01-08 09:00:00"
    assert df.select(extras.in_hours(F.col("t"), {"saturday": (600, 631)})).first()[0] is True


def test_profile_of_texts(spark):
    df = spark.createDataFrame([("30", "2024-01-02", None), ("25", "2024-01-03", None), ("", "x" * 40, " ")], "age string, d string, n string")
    got = {r["column"]: r for r in profiles.profile(df).collect()}
    assert (got["age"].inferred_type, got["age"].null_count, got["age"].min, got["age"].format_pattern) == ("integer", 1, "25", "99")
    assert (got["d"].inferred_type, got["d"].format_pattern, got["n"].inferred_type, got["n"].null_count) == ("date", "9999-99-99", "string", 3)


def test_quality_issues(spark):
    df = spark.createDataFrame([(str(i) if i else None, "a" if i < 24 else "b") for i in range(25)], "n string, k string")
    wanted = [profiles.Expected("n", "integer", constraints=[("max", "17")]), profiles.Expected("k", unique=True)]
    got = {(r["column"], r.dimension): (r.message, r.severity) for r in profiles.issues(profiles.quality(df, wanted), wanted).collect()}
    assert got == {("n", "accuracy"): ("7 values violate constraint max 17", "critical"), ("n", "completeness"): ("1 missing values", "info"), ("k", "uniqueness"): ("23 duplicate values in a column marked unique", "critical")}
    assert profiles.quality(df.limit(0), wanted).count() == 0
