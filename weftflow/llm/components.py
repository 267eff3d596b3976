"""Connected components of a graph given by its edges, as aggregates over nodes and joins back to their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node long, component long) of each node on an edge (a long, b long); a component's id is its smallest node.

    Alternating large and small stars: each round links the neighbours of a node to their smallest, first the larger
    neighbours, then the smaller ones. The smallest neighbours are aggregated before the shuffle and written; the join back to
    the edges can be split by adaptive execution, so a node with very many neighbours is no one task's. A round's tables are
    deleted once the next one's stand. Null ends and loops link nothing; no edges give no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("ok")).filter("ok").drop("ok").distinct(), name)
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        # edges of now have the larger end first, so a node's larger neighbours are at the first end
        larger = cut(now.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct(), name)
        drop(now, least)
        least = cut(larger.groupBy("a").agg(F.min("b").alias("m")), name)
        # the node itself goes with its smallest neighbour, which goes nowhere
        now = cut(larger.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), name)
        # equal for equal edge sets: their number and two sums of hashes
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())
        drop(larger, least)
        if before == mark:
            break
    found = cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), name)
    drop(now)
    return found
