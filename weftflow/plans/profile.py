"""Profiles of a table's columns and a weighted quality score, each as one aggregation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field as field_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.coerce import field, name, text
from ..operators.columns import rule

# Patterns of types, in the order in which they are tried and in which ties fall.
TYPES = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}(:\d{2})?$",
    "integer": r"^-?\d+$",
    "float": r"^-?\d+\.\d+$",
    "boolean": r"(?i)^(true|false|yes|no|0|1)$",
}
CLASSES = [*TYPES, "string"]
PATTERN_BYTES = 32
MOSTLY_NULL = "column %s: %.1f%% of the values are missing"


def type_of(value: Column) -> Column:
    out = F.lit("string")
    for t, pattern in reversed(TYPES.items()):
        out = F.when(value.rlike(pattern), t).otherwise(out)
    return out


def pattern_of(value: Column) -> Column:
    """Digits as 9 and ASCII letters as A; null for values of over 32 bytes."""
    return F.when(F.octet_length(value) <= PATTERN_BYTES, F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-zA-Z]", "A"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A row for each column: inferred type, counts and rates of nulls, distinct values and repeats, least and greatest value, mean bytes, most frequent format.

    Values are texts; white space alone counts as null. Each different value of a column is counted once, before the
    shuffle where it can be; all else is an aggregation over those counts. Ties fall to the first type and the smallest pattern.
    With `approximate` the numbers of distinct values come from sketches, and only formats are shuffled, not values: for tables with
    columns of many different values.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), text(*field(df, c)).cast("string").alias("value")) for i, c in enumerate(df.columns)))
    each = df.select(F.explode(pairs).alias("p")).select("p.*")
    blank = F.coalesce(coerce.strip(F.col("value")) == "", F.lit(True))
    whole = each.select("at", "column", F.when(~blank, F.col("value")).alias("value"), F.lit(1).cast("long").alias("n"))
    counted = whole if approximate else whole.groupBy("at", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("value").isNotNull()
    kinds = [F.sum(F.when(there & (F.col("type") == t), F.col("n")).otherwise(0)).alias(f"t_{t}") for t in CLASSES]
    number = coerce.parse(F.col("value"))
    typed = counted.withColumn("type", type_of(F.col("value"))).withColumn("pattern", pattern_of(F.col("value")))
    per_pattern = typed.groupBy("at", "column", "pattern").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("pn"),
        (F.approx_count_distinct("value", 0.01) if approximate else F.sum(there.cast("long"))).alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"), F.min(number).alias("low_n"), F.max(number).alias("high_n"),
        F.sum(F.octet_length("value") * F.col("n")).alias("bytes"), *kinds,
    )
    total = per_pattern.groupBy("at", "column").agg(
        *(F.sum(c).alias(c) for c in ("rows", "nulls", "distinct", "bytes", *(f"t_{t}" for t in CLASSES))), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_n").alias("low_n"), F.max("high_n").alias("high_n"),
        F.min_by("pattern", F.when(F.col("pattern").isNotNull(), F.struct(-F.col("pn"), F.col("pattern")))).alias("format_pattern"),
    )
    return finished(total)


def finished(total: DataFrame) -> DataFrame:
    """The profile of columns from their counts, bounds and most frequent format."""
    votes = F.array(*(F.struct((-F.col(f"t_{t}")).alias("v"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(CLASSES)))
    inferred = F.when(F.col("rows") == F.col("nulls"), "string").otherwise(F.array_min(votes)["t"])
    filled = F.col("rows") - F.col("nulls")
    numeric = F.col("inferred_type").isin("integer", "float")
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return total.withColumn("inferred_type", inferred).select(
        "column", "inferred_type", F.col("rows").alias("row_count"), F.col("nulls").alias("null_count"), share(F.col("nulls"), F.col("rows")).alias("null_rate"), F.col("distinct").alias("distinct_count"),
        (share(filled - F.col("distinct"), F.greatest(filled, F.lit(1)))).alias("duplicate_rate"),
        F.when(numeric, coerce.number_text(F.col("low_n"), "double")).otherwise(F.col("low")).alias("min"), F.when(numeric, coerce.number_text(F.col("high_n"), "double")).otherwise(F.col("high")).alias("max"),
        F.coalesce(share(F.col("bytes"), filled), F.lit(0.0)).alias("mean_length"), F.coalesce("format_pattern", F.lit("")).alias("format_pattern"),
    )


def sample_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The first values of a column that aren't blank."""
    value = text(*field(df, column))
    return df.filter(~F.coalesce(coerce.strip(value) == "", F.lit(True))).select(value.alias("value")).limit(n)


@dataclass
class Report:
    """What one call tells of a table: its columns, its first rows, warnings, and the seconds that `collect` took."""

    columns: DataFrame
    sample: DataFrame
    warnings: DataFrame
    seconds: float = 0.0

    repeats: DataFrame | None = None

    def collect(self) -> dict[str, list[dict]]:
        """All of it as plain values; the profile runs once, what is mostly null is told from its rows."""
        began = time.time()
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        found = {"columns": rows(self.columns), "sample": rows(self.sample)}
        if self.repeats is None:
            found["warnings"] = rows(self.warnings)
        else:
            found["warnings"] = [{"warning": MOSTLY_NULL % (c["column"], c["null_rate"] * 100)} for c in found["columns"] if (c["null_rate"] or 0) > 0.5] + rows(self.repeats)
        self.seconds = time.time() - began
        return found


def report(df: DataFrame, rows: int = 8, approximate: bool = False) -> Report:
    """Profile, sample and warnings (columns that are mostly null, rows that repeat) of a table; nothing runs before `collect` or an action on a part."""
    columns = profile(df, approximate)
    empty = columns.filter("null_rate > 0.5").select(F.format_string(MOSTLY_NULL, F.col("column"), F.col("null_rate") * 100).alias("warning"))
    repeats = repeated_rows(df).select("warning").filter("warning is not null")
    return Report(columns, df.limit(rows), empty.unionAll(repeats), repeats=repeats)


def repeated_rows(df: DataFrame) -> DataFrame:
    """(rows, repeats, warning): how many rows repeat another one; the warning stands from one in a hundred on."""
    hashed = df.groupBy(*(name(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    counted = hashed.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("repeats"))
    rate = F.try_divide(F.col("repeats") * 100.0, F.col("rows"))
    return counted.select("rows", "repeats", F.when(rate >= 1, F.format_string("duplicate rows detected: %.1f%%", rate)).alias("warning"))


@dataclass
class Expected:
    """What a column should hold: its type, whether values are unique, its format, and rules (kind, value) of min, max and enum."""

    column: str
    type: str = "string"
    unique: bool = False
    pattern: str = ""
    constraints: list[tuple[str, str]] = field_(default_factory=list)


DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "accuracy")


def _measures(df: DataFrame, e: Expected) -> dict[str, Column]:
    c, kind = field(df, e.column)
    value = text(c, kind).cast("string")
    there = F.coalesce(value != "", F.lit(False))
    valid = {
        "integer": value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull(), "float": coerce.parse(value).isNotNull(), "boolean": coerce.boolean(value).isNotNull(),
    }.get(e.type, F.lit(True))
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0))
    out = {"filled": count(there), "invalid": count(there & ~F.coalesce(valid, F.lit(False))), "off": count(there & (F.coalesce(pattern_of(value), value) != e.pattern)) if e.pattern else F.lit(0)}
    out["distinct"] = F.countDistinct(F.when(there, value)) if e.unique else F.lit(0)
    for i, (k, v) in enumerate(e.constraints):
        out[f"broken{i}"] = count(there & ~rule(df, e.column, k, v)) if k in ("min", "max", "enum") else F.lit(0)
    return out


def quality(df: DataFrame, expected: list[Expected]) -> DataFrame:
    """(column and its five dimensions from 0 to 1, with the counts they come from), in one aggregation over the table."""
    found = [(e, {k: v.alias(f"{k}_{i}") for k, v in _measures(df, e).items()}) for i, e in enumerate(expected)]
    total = df.agg(F.count(F.lit(1)).alias("total"), *(c for _, m in found for c in m.values()))
    rows = []
    for i, (e, _) in enumerate(found):
        n, filled = F.col("total"), F.col(f"filled_{i}")
        share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), of.cast("double")), F.lit(0.0))
        validity = 1 - share(F.col(f"invalid_{i}"), filled)
        broken = [share(F.col(f"broken{k}_{i}"), filled) for k in range(len(e.constraints))]
        rows.append(F.struct(
            F.lit(e.column).alias("column"), n.alias("total"), filled.alias("filled"), F.col(f"invalid_{i}").cast("long").alias("invalid"), F.col(f"distinct_{i}").cast("long").alias("distinct"),
            (1 - share(n - filled, n)).alias("completeness"), validity.alias("validity"), (F.when(filled > 0, share(F.col(f"distinct_{i}"), filled)).otherwise(1.0) if e.unique else F.lit(1.0)).alias("uniqueness"),
            (1 - share(F.col(f"off_{i}"), filled)).alias("consistency"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((-b for b in broken), validity))).alias("accuracy"),
            F.array(*(F.col(f"broken{k}_{i}").cast("long") for k in range(len(e.constraints)))).cast("array<bigint>").alias("broken"),
        ))
    return total.filter("total > 0").select(F.inline(F.array(*rows)))


def overall(columns: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The five dimensions as means over the columns and `overall`, their sum by weights (a fifth each, not normalised)."""
    w = dict.fromkeys(DIMENSIONS, 0.2) | (weights or {})
    means = columns.agg(*(F.coalesce(F.avg(d), F.lit(0.0)).alias(d) for d in DIMENSIONS))
    return means.withColumn("overall", sum((F.col(d) * w[d] for d in DIMENSIONS), F.lit(0.0)))


def severity(share: Column) -> Column:
    return F.when(share >= 0.25, "critical").when(share >= 0.05, "warning").otherwise("info")


# The wording of messages, here and of the warning in repeated_rows.
def issues(columns: DataFrame, expected: list[Expected]) -> DataFrame:
    """(column, dimension, message, severity, affected_pct): broken rules, missing values, values of another type, repeats in unique columns."""
    per = []
    for e in expected:
        mine = F.col("column") == e.column
        tell = lambda dim, n, of, message: F.struct(F.lit(dim).alias("dimension"), message.alias("message"), F.try_divide(n.cast("double"), F.greatest(of, F.lit(1)).cast("double")).alias("share"), n.alias("n"))
        text_of = lambda n, s: F.concat(n.cast("string"), F.lit(s))
        filled, gone, again = F.col("filled"), F.col("total") - F.col("filled"), F.col("filled") - F.col("distinct")
        found = [tell("accuracy", F.get("broken", F.lit(k)), filled, text_of(F.get("broken", F.lit(k)), f" values violate constraint {kind} {v}")) for k, (kind, v) in enumerate(e.constraints)]
        found.append(tell("completeness", gone, F.col("total"), text_of(gone, " missing values")))
        found.append(tell("validity", F.col("invalid"), filled, text_of(F.col("invalid"), f" values don't match inferred type {e.type}")))
        if e.unique:
            found.append(tell("uniqueness", again, filled, text_of(again, " duplicate values in a column marked unique")))
        per.append(F.when(mine, F.array(*found)))
    return columns.select("column", F.inline(F.coalesce(*per))).filter("n > 0").select("column", "dimension", "message", severity(F.col("share")).alias("severity"), (F.col("share") * 100).alias("affected_pct"))
