"""Profiles by states that merge, against exact ones."""

from weftflow.plans import profile, sketches

SF = "/root/testdata/sf0.001"


def by_column(df):
    return {r.column: r.asDict() for r in df.collect()}


def close(a, b):
    return abs(a - b) <= max(1, 4 * sketches.ERROR * b)


def test_states_tell_the_profile(spark):
    for t in ("customer", "lineitem", "events"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        exact, got = by_column(profile.profile(df)), by_column(sketches.estimates(sketches.states(df)))
        assert got.keys() == exact.keys()
        for c, want in exact.items():
            own = got[c]
            assert close(own.pop("distinct_count"), want.pop("distinct_count")) and abs(own.pop("duplicate_rate") - want.pop("duplicate_rate")) <= 4 * sketches.ERROR
            assert own == want


def test_parts_merge_to_the_whole(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    a, b = df.filter("o_orderkey % 3 = 0"), df.filter("o_orderkey % 3 <> 0")
    sketches.states(a).write.parquet(str(tmp_path / "a"))  # a state that is kept
    both = sketches.merged(spark.read.parquet(str(tmp_path / "a")), sketches.states(b))
    assert by_column(sketches.estimates(both)) == by_column(sketches.estimates(sketches.states(df)))
    nothing = sketches.merged(sketches.states(df.limit(0)), sketches.states(df))
    assert by_column(sketches.estimates(nothing)) == by_column(sketches.estimates(sketches.states(df)))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, " ", "1"), (None, "", "02"), (None, None, "x" * 40)], "`a.b` string, `c``d` string, e string")
    assert by_column(sketches.estimates(sketches.states(df))) == by_column(profile.profile(df))


def test_no_cell_is_exploded(spark, capsys, monkeypatch):
    monkeypatch.setattr(sketches, "cut", lambda df, name: df.explain("formatted") or df)
    sketches.states(spark.read.parquet(f"{SF}/customer.parquet"))
    plan = capsys.readouterr().out
    assert "Aggregate" in plan and "Generate" not in plan and "Expand" not in plan and plan.count("Scan parquet") == 2  # named in the tree and in its details


def test_report_profiles_once(spark):
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, None), (2, None), (3, "x")], "a long, b string").select(F.udf(lambda a: seen.add(1) or a, "long").asNondeterministic()("a").alias("a"), "b")
    found = profile.report(df).collect()
    assert [w["warning"] for w in found["warnings"]] == ["column b: 75.0% of the values are missing", "duplicate rows detected: 25.0%"]
    assert len(found["columns"]) == 2 and len(found["sample"]) == 4 and seen.value <= 12  # profile, sample and repeats
