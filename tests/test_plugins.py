"""Nodes, readers and writers of one's own, and writes that fail."""

import json
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftflow.operators import NODES
from weftflow.operators.base import batch_node
from weftflow.plans.pipeline import run
from weftflow.sources import files, plugins


class Netstrings(plugins.Format):
    """A test format: each row as the length of its JSON, a colon, and the JSON."""

    @classmethod
    def name(cls):
        return "netstrings"

    def schema(self):
        return "id long, text string"

    def encode(self, batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["text"] == "bad":
                    raise ValueError("a row that can't be written")
                data = json.dumps(row).encode()
                yield b"%d:%s" % (len(data), data)

    def decode(self, file):
        while head := file.read(1):
            while (c := file.read(1)) != b":":
                head += c
            yield pa.RecordBatch.from_pylist([json.loads(file.read(int(head)))], pa.schema([("id", pa.int64()), ("text", pa.string())]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


@pytest.fixture
def form(spark):
    plugins.add_format(spark, Netstrings)
    yield "netstrings"
    files.READERS.pop("netstrings")


def table(spark, n):
    return spark.range(0, n, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é "), F.col("id"))).alias("text"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_format(spark, form, tmp_path):
    path = str(tmp_path / "out")
    table(spark, 100).write.format(form).mode("append").save(path)
    assert "netstrings" in files.formats() and rows(files.read(spark, path, form)) == rows(table(spark, 100))
    assert files.read(spark, path, form).rdd.getNumPartitions() == 4 and not (tmp_path / "out" / "_staged").exists()
    table(spark, 3).write.format(form).mode("append").save(path)
    assert files.read(spark, path, form).count() == 103
    table(spark, 5).write.format(form).mode("overwrite").save(path)
    assert rows(files.read(spark, f"file://{path}", form)) == rows(table(spark, 5))
    table(spark, 0).write.format(form).mode("overwrite").save(path)
    assert files.read(spark, path, form).count() == 0


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_failed_write_leaves_nothing(spark, form, tmp_path, mode):
    path = str(tmp_path / "out")
    table(spark, 10).write.format(form).mode("append").save(path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="can't be written"):
        spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 99, "bad").alias("text")).write.format(form).mode(mode).save(path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before and rows(files.read(spark, path, form)) == rows(table(spark, 10))


def test_node_over_batches(spark):
    """A node that gives several rows for one, none for another, and sees batches of bounded size."""

    @batch_node("testRepeat", lambda x: "id long, n int, seen int", rows=7)
    def repeat(batches, config):
        for b in batches:
            picked = pa.array([i for i, n in enumerate(b.column("n").to_pylist()) for _ in range(n or 0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.take(picked).columns, pa.array([min(b.num_rows, config["most"])] * len(picked), pa.int32())], [*b.schema.names, "seen"])

    try:
        df = spark.range(0, 50, 1, 2).select("id", F.when(F.col("id") > 0, F.col("id") % 3).cast("int").alias("n"))
        document = {"nodes": [{"id": "a", "type": "input"}, {"id": "r", "type": "testRepeat", "config": {"most": 99}}, {"id": "f", "type": "filterRows", "config": {"expression": "id < 40"}}], "edges": [{"from": "a", "to": "r"}, {"from": "r", "to": "f"}]}
        got = run(document, {"a": df}).collect()
        assert sorted(r["id"] for r in got) == [i for i in range(1, 40) for _ in range(i % 3)] and max(r["seen"] for r in got) == 7
        assert run(document, {"a": df.limit(0)}).collect() == []
    finally:
        NODES.pop("testRepeat")
