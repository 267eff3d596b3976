"""A training corpus from raw documents: quality, toxicity and near-duplicate filters, then packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftflow.llm import jaccard, packing, quality, toxicity
from weftflow.llm.common import cut, free_name, table
from weftflow.llm.queries import GOOD, TOXIC


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is GOOD at least. The classifier learns from the labelled documents of its input.

    Null and empty texts get the classifier's bias as their score. Null labels and ids take no part in learning; without labels the
    score is one half, so no document stays. Rows that repeat stay or go together. All columns of the input, whatever their
    names, are returned as they are; an empty table gives no rows.
    """
    score = free_name(docs, "_score")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col=score).filter(F.col(score) >= GOOD).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC. The classifier learns from the labelled documents of its input.

    Null and empty texts have no toxic passage and stay where most documents aren't toxic. Null labels and ids take no part in
    learning; without labels the score is one half, so no document stays. Rows that repeat stay or go together. All columns of the
    input, whatever their names, are returned as they are; an empty table gives no rows.
    """
    score = free_name(docs, "_score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect stays, that with the smallest id. Empty texts and documents without an id stay.

    Rows that repeat an id are documents of their own; of those with equal or connected texts, or with empty ones, the first by text stays.
    All columns of the input, whatever their names, are returned as they are; an empty table gives no rows.
    """
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        return drop_near_copies_by_row(docs, repeated)
    found = cut(jaccard.join(docs, size=5, percent=80), "groups")
    gone = found.filter("doc_id <> component_id").select("doc_id")
    side = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies_by_row(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The same for documents some of whose ids, the `repeated` ones, stand in several rows: each row with an id gets a key of its own."""
    key = free_name(docs, "_key")
    rows = cut(docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "keyed")
    own = rows.select(F.col(key).alias("_key"), "doc_id", "text")
    found = cut(jaccard.join(own.select(F.col("_key").alias("doc_id"), "text"), size=5, percent=80), "groups")
    groups = found.filter("doc_id is not null").select(F.col("doc_id").alias("_key"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group"))
    placed = cut(own.select("_key", "doc_id").join(groups, "_key"), "placed")
    least = placed.filter("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    larger = placed.join(least, "_group").filter("doc_id <> _least").select("_key")
    # of the rows of one id and group all but the first by text go; it is aggregated before the shuffle, as there may be very many
    again = placed.join(repeated, "doc_id", "left_semi").join(own.select("_key", "text"), "_key")
    first = cut(again.groupBy("doc_id", "_group").agg(F.min(F.struct(F.col("text").isNull().alias("n"), "text", "_key")).alias("f")).select(F.col("f._key").alias("_key")), "first")
    gone = cut(larger.unionAll(again.select("_key").join(first, "_key", "left_anti")).distinct().withColumnRenamed("_key", key), "gone")
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens at most; the columns are those of `packing.pack`.

    Null and empty texts have the end token alone. Null ids stay null, repeated rows are packed each, other columns are left
    behind; an empty table gives no rows.
    """
    return packing.pack(docs, added_ids=True)


STAGES = [("quality classifier", keep_good), ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: SQL can express neither the classifiers nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
