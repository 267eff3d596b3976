"""Conversions between the loose types of pipeline documents and Spark's static types, as plain column expressions.

A value is a column with a kind: string, long, double, boolean, time (dates and timestamps), nested or null. The kind comes
from the schema, so each conversion picks its expression when the plan is built and nothing is decided per row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
#: Texts that are read as booleans.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
EXACT = float(1 << 53)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "long"
    if isinstance(t, T.NumericType):
        return "double"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "null" if isinstance(t, T.NullType) else "nested"


def name(column: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def field(df: DataFrame, column: str) -> tuple[Column, str]:
    """A column and its kind; a column that the schema lacks is null."""
    if column in df.columns:
        return name(column), kind_of(df.schema[column].dataType)
    return F.lit(None), "null"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def parse(c: Column) -> Column:
    """The double that a text spells, or null. Suffixes such as 1d and white space are no part of a number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def try_number(c: Column, kind: str, trim: bool = False) -> Column:
    """The double of a number or of a text that spells one; null for all else."""
    if kind in ("long", "double"):
        return c.cast("double")
    if kind == "string":
        return parse(strip(c) if trim else c)
    return F.lit(None).cast("double")


def number(c: Column, kind: str) -> Column:
    """The double of anything: booleans are 1 and 0, what isn't a number is 0."""
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("double"), F.lit(0.0))
    return F.coalesce(try_number(c, kind, trim=True), F.lit(0.0))


def number_text(c: Column, kind: str) -> Column:
    """Plain decimals: no exponent, no trailing zeros."""
    if kind == "long":
        return c.cast("string")
    x = c.cast("double")
    size = F.abs(x)
    trimmed = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf")
        .when((size < EXACT) & (x == F.floor(x).cast("double")), x.try_cast("bigint").cast("string"))
        .when(size >= EXACT, F.format_string("%.0f", x))
        .when(size >= 1e-12, trimmed(x.try_cast("decimal(38,22)").cast("string")))
        .otherwise(trimmed(F.format_string("%.340f", x)))
    )


def text(c: Column, kind: str) -> Column:
    """The text of a value, null for null."""
    if kind in ("long", "double"):
        return number_text(c, kind)
    if kind == "nested":
        return F.to_json(c)
    return c if kind == "string" else c.cast("string")


def shown(c: Column, kind: str) -> Column:
    """The text of a value, empty for null."""
    return F.coalesce(text(c, kind), F.lit(""))


def truthy(c: Column, kind: str) -> Column:
    """Never null: numbers other than 0 and texts other than the empty one and "false" are true."""
    if kind == "null":
        return F.lit(False)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("long", "double"):
        return F.coalesce(c != 0, F.lit(False))
    if kind == "string":
        return F.coalesce((c != "") & (F.lower(c) != "false"), F.lit(False))
    return c.isNotNull()


def missing(c: Column, kind: str) -> Column:
    return F.lit(True) if kind == "null" else F.coalesce(text(c, kind) == "", F.lit(True)) if kind == "string" else c.isNull()


def same_kind(values: list[tuple[Column, str]]) -> tuple[list[Column], str]:
    """Values brought to one kind: their own, double for numbers, else text."""
    kinds = {k for _, k in values if k != "null"}
    if not kinds:
        return [c for c, _ in values], "null"
    if len(kinds) == 1:
        return [c for c, _ in values], kinds.pop()
    if kinds <= {"long", "double"}:
        return [c.cast("double") for c, _ in values], "double"
    return [text(c, k) if k != "null" else F.lit(None).cast("string") for c, k in values], "string"


def boolean(c: Column) -> Column:
    return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False)


def cast(c: Column, kind: str, to: str) -> Column:
    """A value as integer, float, boolean or string, null where it isn't one; other types leave it as it is."""
    if to == "integer":
        return c.cast("bigint") if kind == "long" else try_number(c, kind, trim=True).try_cast("bigint")
    if to == "float":
        return try_number(c, kind, trim=True)
    if to == "boolean":
        return c if kind == "boolean" else boolean(F.coalesce(text(c, kind), F.lit(None).cast("string")))
    return text(c, kind) if to == "string" else c
