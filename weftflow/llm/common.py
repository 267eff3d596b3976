"""Helpers that the corpus operators share: tables, the shared work folder, folds and Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import cut, drop, remove, shared_dir, work_dir  # noqa: F401

#: Rows of one Arrow slice that a Python operator holds and returns at a time.
SLICE_ROWS = 256
#: Rows of an Arrow batch between Spark and Python.
ARROW_ROWS = 1000
#: Bytes of a text that a classifier is fitted to, at most.
TRAIN_TEXT_BYTES = 128 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of ARROW_ROWS rows at most: the session's setting is lowered to it, since thousands of long texts a batch would fill an executor."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= ARROW_ROWS:
        df.sparkSession.conf.set(setting, ARROW_ROWS)
    return df.mapInArrow(run, schema)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while jobs run within the block; those from before come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done now, rather than when the driver's memory is next cleared."""
    spark.range(1).write.format("noop").mode("overwrite").save()  # Spark holds on to the last plan that ran
    gc.collect()  # and Python to plans that it hasn't let go yet
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def hash_share(hashed: Column, count: int, rows: int) -> Column:
    """True for so large a share of `count` hashes that about `rows` are left, all where there are no more: sorts and limits after it see a bounded number."""
    return F.pmod(hashed, F.lit(1_000_000)) < F.lit(min(1_000_000, -(-rows * 1_000_000 // max(count, 1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold.

    The sample is bounded by `rows`, and by TRAIN_TEXT_BYTES for each text: longer ones take no part. It is drawn by a hash of
    the id, so that it is the same in each run. Null ids and null labels take no part; of several labels of an id the larger one
    counts. Its ids are broadcast (at most `rows` pairs of integers), so the documents aren't shuffled.
    """
    pick = F.xxhash64("doc_id")
    able = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = able.filter(hash_share(pick, able.count(), 2 * rows)).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(pick, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    return texts.join(F.broadcast(known), "doc_id").orderBy(pick, "doc_id", "text").limit(rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
