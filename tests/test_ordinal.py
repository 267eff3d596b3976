"""Row numbers without a write, exports in order whatever the sizes of files, and exact random samples of any size."""

import json

from pyspark.sql import functions as F

from weftflow.operators import NODES, Inputs
from weftflow.operators.ordinal import by_files, is_plain, with_ordinal
from weftflow.sources import exports


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def table(spark, path, sizes=(3, 200, 0, 40)):
    """A table of files of unlike sizes, the values in the order of the files' names."""
    start = 0
    for i, n in enumerate(sizes):
        spark.range(start, start + n, 1, 1).select("id", F.col("id").cast("string").alias("t")).write.parquet(f"{path}/part={i}")
        start += n
    return spark.read.parquet(str(path)).drop("part"), start


def test_numbers_of_a_plain_scan(spark, tmp_path, capsys):
    df, n = table(spark, tmp_path / "t")
    rows, total = with_ordinal(df.select("id", F.upper("t").alias("T")), [])
    assert total == n and rows.columns == ["id", "T", "__i"] and [tuple(r) for r in rows.select("id", "__i").orderBy("__i").collect()] == [(i, i) for i in range(n)]
    shown = plan(rows, capsys)
    assert "cut" not in shown and "rows-" not in shown and str(tmp_path / "t") in shown and "ReadSchema: struct<>" in shown  # files are counted by their footers


def test_what_is_no_plain_scan(spark, tmp_path):
    df, n = table(spark, tmp_path / "t")
    for other in (df.filter("id > 3"), df.orderBy("id"), df.limit(3), df.select(F.explode(F.array("id", "id")).alias("id")), df.unionAll(df), df.join(df.select("id"), "id"), df.distinct(), spark.range(3), df.sample(0.5)):
        assert not is_plain(other) and by_files(other) is None
        rows, total = with_ordinal(other, [])
        assert sorted(r["__i"] for r in rows.collect()) == list(range(total))
    df.write.json(str(tmp_path / "j"))
    assert by_files(spark.read.json(str(tmp_path / "j"))) is None  # its rows have no place that Spark tells
    df.createOrReplaceTempView("numbered")
    assert by_files(spark.table("numbered")) is None  # views hide it
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "none"))
    rows, total = with_ordinal(spark.read.parquet(str(tmp_path / "none")), [])
    assert total == 0 and rows.collect() == []


def test_json_export_ends_where_it_should(spark, tmp_path):
    """The last row has no comma, and stands last, though Spark reads large files first."""
    df, n = table(spark, tmp_path / "t")
    for i, rows in enumerate((df.select("id"), df.select("id").filter("id >= 0"), spark.range(5, numPartitions=1).unionAll(spark.range(5, 900, 1, 1)))):
        exports.write(rows, str(tmp_path / f"out{i}"), "json")
        whole = "\n".join(p.read_text() for p in sorted((tmp_path / f"out{i}").glob("part-*")))
        assert len(json.loads(whole)) == rows.count()
        exports.export_lines(rows, "json").coalesce(1).write.text(str(tmp_path / f"one{i}"))
        one = "\n".join(p.read_text() for p in (tmp_path / f"one{i}").glob("part-*"))
        assert [x["id"] for x in json.loads(one)] == [x["id"] for x in json.loads(whole)]
    assert [x["id"] for x in json.loads(whole)] == list(range(900))
    assert [r[0] for r in exports.export_lines(spark.range(0), "json").collect()] == ["[", "]"]


def sample(df, size, **config):
    return NODES["sampling"](Inputs(df, config={"size": size, "method": "random", "seed": 5} | config)).df


def test_random_samples_of_any_size(spark, tmp_path, capsys):
    df = spark.range(0, 40_000, 1, 8)
    for size in (1, 37, 3_000, 39_990, 40_000, 50_000):
        got = [r[0] for r in sample(df, size).collect()]
        assert len(got) == len(set(got)) == min(size, 40_000) and got == sorted(got)
    small, large = ({r[0] for r in sample(df, n).collect()} for n in (500, 5_000))
    assert small < large  # the smallest of the same random numbers
    assert abs(sum(large) / len(large) - 20_000) < 1_000
    shown = plan(sample(df, 5_000), capsys)
    assert "TakeOrdered" not in shown and "SinglePartition" not in shown and "Limit" not in shown
    assert sample(df.limit(0), 5).count() == 0
    ordered = [r[0] for r in sample(df.select((-F.col("id")).alias("k")), 50, orderBy=["k"]).collect()]
    assert ordered == sorted(ordered)
