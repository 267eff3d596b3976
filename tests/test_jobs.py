"""Jobs that are watched and cancelled, rows and errors in one pass, and what nodes tell of a run."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from weftflow.plans import jobs
from weftflow.plans.pipeline import Pipeline


def until(condition, seconds=30):
    ends = time.time() + seconds
    while not condition() and time.time() < ends:
        time.sleep(0.05)
    return condition()


def slow(spark):
    """A table of 8 tasks that takes far longer than a test may."""
    nap = F.udf(lambda i: time.sleep(0.05) or i, "long")
    return spark.range(0, 80_000, 1, 8).select(nap("id").alias("id"))


def write(df):
    df.write.format("noop").mode("overwrite").save()


def test_cancel_a_running_spark_job(spark):
    df = slow(spark)
    job = jobs.submit(df, write, lambda _: "never")
    assert until(lambda: jobs.progress(df, job).tasks_running > 0)
    assert jobs.cancel(df, job) and job.wait(60).status == "cancelled" and job.done == 0 and job.result is None
    assert not jobs.cancel(df, job)


def test_cancel_a_running_step_of_the_driver(spark):
    gone, began = threading.Event(), threading.Event()
    job = jobs.submit(spark.range(1), lambda df: (began.set(), gone.wait(30), "late")[-1])
    assert began.wait(30) and jobs.cancel(spark.range(1), job)
    gone.set()
    assert job.wait(30).status == "cancelled" and job.result is None and job.done == 0


def test_cancel_a_finished_job(spark):
    df = spark.range(100)
    job = jobs.submit(df, lambda d: d.count()).wait(60)
    assert not jobs.cancel(df, job) and job.status == "completed" and job.result == 100 and job.done == 1


def test_hold_resume_and_fail(spark):
    df = spark.range(5)
    job = jobs.submit(df, lambda d: d.count(), paused=True)
    assert until(lambda: job.status == "paused") and job.result is None
    jobs.resume(job)
    assert job.wait(60).status == "completed"
    failed = jobs.submit(df, lambda d: d.select(F.raise_error(F.lit("no")).cast("int").alias("x")).collect()).wait(60)
    assert failed.status == "failed" and "no" in failed.error


def test_progress(spark, tmp_path):
    spark.range(0, 10_000, 1, 4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    job = jobs.submit(df, write).wait(60)
    found = jobs.progress(df, job)
    assert found.tasks == found.tasks_done > 0 and found.tasks_running == found.tasks_failed == 0
    assert found.rows_read == 10_000 and found.rows_per_second > 0


CASTS = {
    "nodes": [
        {"id": "in", "type": "input"}, {"id": "cast", "type": "typeCast", "config": {"casts": {"v": "integer"}}}, {"id": "big", "type": "filterRows", "config": {"expression": "10 / v > 1"}},
        {"id": "said", "type": "selectColumns", "config": {"columns": ["message"]}}, {"id": "dropped", "type": "selectColumns", "config": {"columns": ["message"]}}, {"id": "both", "type": "union", "config": {}}, {"id": "out", "type": "output"},
    ],
    "edges": [
        {"from": "in", "to": "cast"}, {"from": "cast", "to": "big"}, {"from": "cast", "fromPort": "errors", "to": "said"}, {"from": "big", "fromPort": "errors", "to": "dropped"},
        {"from": "big", "to": "both"}, {"from": "said", "to": "both", "toPort": "b"}, {"from": "dropped", "to": "both", "toPort": "b"}, {"from": "both", "to": "out"},
    ],
}


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame([("5",), ("x",), ("0",), (None,), ("50",)], "v string").write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_and_errors_in_one_pass(spark, texts, tmp_path, capsys):
    apart = Pipeline.parse(CASTS).bind({"in": texts}, part_errors=False)
    once = Pipeline.parse(CASTS).bind({"in": texts})
    assert key(once.output()) == key(apart.output()) and once.output().columns == apart.output().columns
    for node in ("cast", "big"):
        assert key(once.errors[node]) == key(apart.errors[node]) and key(once.frames[node]) == key(apart.frames[node])

    def scans(df):
        df.explain("formatted")
        return capsys.readouterr().out.count(f"InMemoryFileIndex [file:{tmp_path}/in")

    assert scans(apart.output()) > 1
    seen = spark.sparkContext.accumulator(0)
    counted = texts.select(F.udf(lambda v: seen.add(1) or v, "string").asNondeterministic()("v").alias("v"))
    Pipeline.parse(CASTS).bind({"in": counted}).output().collect()
    assert seen.value == 5  # each row of the input was read once for both ports of both nodes
    assert scans(once.output()) == 0


def test_what_nodes_tell_of_a_run(texts):
    result = Pipeline.parse(CASTS).bind({"in": texts}, observe=True, part_errors=False)
    write(result.frames["big"])
    cast, big = result.facts("cast"), result.facts("big")
    assert {k: cast[k] for k in ("rows_in", "rows", "errors")} == {"rows_in": 5, "rows": 5, "errors": 1}
    assert (big["rows_in"], big["rows"]) == (5, 1) and result.failed("big") == big["errors"] > 0
    assert cast["milliseconds"] >= 0 and big["milliseconds"] >= 0


def test_fill_of_a_name_with_backticks(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "")], "`x``y` double, `p.q` string")
    for strategy, want in (("mean", [(1.0, "a"), (1.0, "")]), ("mode", [(1.0, "a"), (1.0, "a")])):
        doc = {"nodes": [{"id": "in", "type": "input"}, {"id": "f", "type": "fillMissingValues", "config": {"fills": {"x`y": None} | ({"p.q": None} if strategy == "mode" else {}), "strategy": strategy}}], "edges": [{"from": "in", "to": "f"}]}
        got = key(Pipeline.parse(doc).bind({"in": df}).output())
        assert [(float(a), b) for a, b in got] == sorted(want, key=repr)
