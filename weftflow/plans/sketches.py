"""Profiles that merge: the state of each column in one aggregation, kept for partitions that are there and merged with those that come.

A state holds exact counts of rows, nulls, types and bytes, exact bounds, a HyperLogLog sketch of the values and a frequent-items sketch of
the formats. States of parts of a table merge into that of the table. Numbers of distinct values then differ by ERROR at most in about two
of three cases, by three times that hardly ever; the most frequent format is exact while a column has fewer than TRACKED formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.coerce import field, name, text
from ..operators.shared import cut
from .profile import CLASSES, finished, pattern_of, type_of

#: Binary logarithm of a HyperLogLog sketch's registers, and its relative standard error.
LG_K = 14
ERROR = 1.04 / (1 << LG_K) ** 0.5
#: Formats that the sketch of frequent ones tracks.
TRACKED = 10_000

SUMS = ("rows", "nulls", "bytes", *(f"t_{t}" for t in CLASSES))


def state_of(i: int, column: str) -> list[Column]:
    """The aggregates of one column, over the columns v, t, p, n with its number that `states` makes of its values."""
    v, t, p, n = (F.col(f"{k}{i}") for k in "vtpn")
    counts = [F.count(F.lit(1)), F.count_if(v.isNull()), F.coalesce(F.sum(F.octet_length(v).cast("long")), F.lit(0).cast("long")), *(F.count_if(v.isNotNull() & (t == c)) for c in CLASSES)]
    return [
        F.lit(i).alias("at"), F.lit(column).alias("column"), *(c.alias(s) for c, s in zip(counts, SUMS, strict=True)),
        F.min(v).alias("low"), F.max(v).alias("high"), F.min(n).alias("low_n"), F.max(n).alias("high_n"),
        F.hll_sketch_agg(v, LG_K).alias("values"), F.expr(f"approx_top_k_accumulate(p{i}, {TRACKED}) FILTER (WHERE p{i} IS NOT NULL)").alias("formats"),
    ]


def states(df: DataFrame) -> DataFrame:
    """A row for each column of a table, its state; one aggregation without exploding a cell, whose one row is stored and then dealt out."""
    parts: list[Column] = []
    for i, c in enumerate(df.columns):
        value = text(*field(df, c)).cast("string")
        blank = F.coalesce(coerce.strip(value) == "", F.lit(True))
        parts.append(F.when(~blank, value).alias(f"v{i}"))
    values = df.select(*parts)
    seen = values.select("*", *(x for i in range(len(df.columns)) for x in (type_of(F.col(f"v{i}")).alias(f"t{i}"), pattern_of(F.col(f"v{i}")).alias(f"p{i}"), coerce.parse(F.col(f"v{i}")).alias(f"n{i}"))))
    row = seen.agg(*(F.struct(*state_of(i, c)).alias(f"s{i}") for i, c in enumerate(df.columns)))
    return cut(row, "states").select(F.inline(F.array(*(name(f"s{i}") for i in range(len(df.columns))))))


def merged(*parts: DataFrame) -> DataFrame:
    """The states of a table from those of its parts, by the columns' names; parts may be read back from storage."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    lows = [F.min(c).alias(c) for c in ("low", "low_n")] + [F.max(c).alias(c) for c in ("high", "high_n")]
    found = whole.groupBy("column").agg(
        F.min("at").alias("at"), *(F.sum(c).alias(c) for c in SUMS), *lows, F.hll_union_agg("values").alias("values"), F.expr("approx_top_k_combine(formats)").alias("formats")
    )
    return found.select(*whole.columns)


def estimates(state: DataFrame) -> DataFrame:
    """The profile that states tell, with the columns of `profile`."""
    best = F.expr("approx_top_k_estimate(formats, 50)")
    most = F.array_max(F.transform(best, lambda x: x["count"]))
    # of equally frequent formats the smallest
    pattern = F.array_min(F.transform(F.filter(best, lambda x: x["count"] == most), lambda x: x["item"]))
    filled = F.col("rows") - F.col("nulls")
    distinct = F.least(filled, F.hll_sketch_estimate("values"))
    return finished(state.withColumn("distinct", distinct).withColumn("format_pattern", pattern))
