"""Streams that start again give the rows of a table: duplicates, first and last values."""

import datetime

import pytest

from weftflow.operators import AnalysisError
from weftflow.plans.pipeline import run
from weftflow.streaming.pipelines import bind_stream, write_stream

SCHEMA = "k string, at timestamp, rank int, v long"
START = datetime.datetime(2024, 1, 1)


def event(k, minute, rank, v):
    return (k, START + datetime.timedelta(minutes=minute), rank, v)


#: Batches as they arrive; the last row only moves the watermark on.
BATCHES = [
    [event("a", 0, 3, 1), event("b", 1, 1, 2), event(None, 1, 2, 3), event("a", 2, 1, 1 << 60)],
    [event("a", 4, 2, 5), event("b", 3, 0, None), event(None, 3, 2, 7)],
    [event("c", 12, 1, 8), event("b", 5, 9, 9), event("c", 12, 1, 8)],
    [event("end", 600, 0, 0)],
]


def document(*nodes):
    ids = ["in", *(f"n{i}" for i in range(len(nodes)))]
    return {"nodes": [{"id": "in", "type": "input"}, *({"id": i, "type": t, "config": c} for i, (t, c) in zip(ids[1:], nodes, strict=True))], "edges": [{"from": a, "to": b} for a, b in zip(ids, ids[1:], strict=False)]}


def streamed(spark, tmp_path, doc):
    """The rows that a stream has written after it was started anew for each batch of files."""
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = bind_stream(doc, {"in": stream}, watermark=("at", "10 minutes"))
        write_stream(out, str(tmp_path / "checkpoint")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def told(spark, doc):
    table = spark.createDataFrame([e for b in BATCHES[:-1] for e in b], SCHEMA)
    return sorted((tuple(r) for r in run(doc, {"in": table}).collect()), key=repr)


def test_first_row_by_order(spark, tmp_path):
    doc = document(("deduplicate", {"keys": ["k"], "orderBy": ["rank", "at", "v"]}))
    got = streamed(spark, tmp_path, doc)
    assert got == told(spark, doc) and ("a", START + datetime.timedelta(minutes=2), 1, 1 << 60) in got and len(got) == 4


def test_first_row_to_arrive(spark, tmp_path):
    got = [r for r in streamed(spark, tmp_path, document(("deduplicate", {"keys": ["k"]}))) if r[0] != "end"]
    assert [r[0] for r in got] == ["a", "b", "c", None] and got[1][3] == 2


def test_repeated_rows(spark, tmp_path):
    doc = document(("deduplicate", {}))
    assert [r for r in streamed(spark, tmp_path, doc) if r[0] != "end"] == told(spark, doc)


def test_first_and_last_values(spark, tmp_path):
    doc = document(("groupByAggregate", {"keys": ["k", "at"], "orderBy": ["rank", "v"], "aggregations": [{"column": "v", "func": f, "as": f} for f in ("first", "last", "count")]}))
    assert streamed(spark, tmp_path, doc) == told(spark, doc)


def test_rows_far_apart(spark):
    """In a table, too, rows further apart than the delay are apart."""
    table = spark.createDataFrame([event("a", m, 0, m) for m in (0, 5, 14, 30, 39)], SCHEMA)
    found = run(document(("deduplicate", {"keys": ["k"], "orderBy": ["at"], "within": ["at", "10 minutes"]})), {"in": table})
    assert sorted(r["v"] for r in found.collect()) == [0, 30]


def test_what_a_stream_refuses(spark, tmp_path):
    spark.createDataFrame(BATCHES[0], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for node in (("deduplicate", {"keys": ["k"]}), ("groupByAggregate", {"keys": ["k"], "aggregations": [{"column": "v", "func": "first"}]})):
        with pytest.raises(AnalysisError, match="stream"):
            bind_stream(document(node), {"in": stream})
    with pytest.raises(AnalysisError, match="needs order"):
        bind_stream(document(("groupByAggregate", {"keys": ["k"], "aggregations": [{"column": "v", "func": "first"}]})), {"in": stream}, watermark=("at", "1 minute"))
