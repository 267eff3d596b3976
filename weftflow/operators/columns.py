"""Nodes that work within a row: projection, casts, filling, formulas, texts, filters and rules. None needs a shuffle, but for filling with a mean or mode."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, formula
from ..functions.coerce import field, name, text
from .base import AnalysisError, Inputs, Output, failing, node, stopping


def with_column(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Set or add a column by its literal name."""
    if column not in df.columns:
        return df.select("*", value.alias(column))
    return df.select(*(value.alias(c) if c == column else name(c) for c in df.columns))


def mapped(x: Inputs, f, target: str | None = None) -> DataFrame:
    """Set a column from the text of the configured one."""
    column = x.get("column", str, "")
    if column not in x.main.columns:
        return x.main
    return with_column(x.main, target or column, f(text(*field(x.main, column))))


@node("selectColumns")
def select_columns(x: Inputs) -> DataFrame:
    """`columns` in this order, none: all; a column that isn't there is null."""
    wanted = x.get("columns", list, [])
    return x.main.select(*(field(x.main, c)[0].alias(c) for c in wanted)) if wanted else x.main


@node("renameColumns")
def rename_columns(x: Inputs) -> DataFrame:
    """`mapping` from old to new names, all at once, so that names can be swapped; a new name overwrites a column that keeps it."""
    mapping = {a: b for a, b in x.get("mapping", dict, {}).items() if a in x.main.columns}
    taken = set(mapping.values())
    return x.main.select(*(name(c).alias(mapping.get(c, c)) for c in x.main.columns if c in mapping or c not in taken))


@node("typeCast")
def type_cast(x: Inputs) -> Output:
    """`casts` from columns to integer, float, boolean or string. A value that isn't one becomes null and an error row."""
    df, casts, messages = x.main, x.get("casts", dict, {}), []
    done: dict[str, Column] = {}
    for column, to in casts.items():
        c, kind = field(df, column)
        value = coerce.cast(c, kind, to)
        if to in ("integer", "float", "boolean") and kind != "null":
            bad = F.when(c.isNotNull() & value.isNull(), F.concat(F.lit('typeCast: cannot cast "'), F.coalesce(text(c, kind), F.lit("")), F.lit(f'" to {to}')))
            value = stopping(value, bad, x.on_error)
            messages.append(bad)
        done[column] = value
    columns = [*((done[c] if c in done else name(c)).alias(c) for c in df.columns), *(v.alias(c) for c, v in done.items() if c not in df.columns)]
    out = df.select(*columns)
    return failing(df, out, F.coalesce(*messages), columns=columns) if messages else Output(out)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of m0, m1, ...: the most frequent text of each column that isn't empty, of equally frequent ones the smallest, "" without any."""
    texts = F.array(*(F.struct(F.lit(i).alias("i"), F.when(~coerce.missing(*field(df, c)), text(*field(df, c)).cast("string")).alias("v")) for i, c in enumerate(columns)))
    counted = df.select(F.explode(texts).alias("p")).select("p.*").filter(F.col("v").isNotNull()).groupBy("i", "v").count()
    best = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
    return best.agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("v"))), F.lit("")).alias(f"m{i}") for i in range(len(columns))))


@node("fillMissingValues")
def fill_missing(x: Inputs) -> DataFrame:
    """Null and empty values of the columns in `fills`: the given value, or by `strategy` the column's mean or mode.

    The mean is of the values that are numbers, 0 without any; the mode is the most frequent text, of equal ones the smallest.
    Whatever their number, one aggregation over the input gives all means or modes; its single row is broadcast.
    """
    df, strategy = x.main, x.get("strategy", str, "static")
    fills = x.get("fills", dict, {})
    found = None
    if fills and strategy == "mean":
        found = df.agg(*(F.coalesce(F.avg(coerce.try_number(*field(df, c))), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(fills)))
    elif fills and strategy == "mode":
        found = modes(df, list(fills))
    given = lambda v: (F.lit(v), "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "null" if v is None else "double")
    values = {c: (F.col(f"found.m{i}"), "double" if strategy == "mean" else "string") if found is not None else given(v) for i, (c, v) in enumerate(fills.items())}
    own = lambda c: F.col("main.`" + c.replace("`", "``") + "`") if found is not None else name(c)
    done: dict[str, Column] = {}
    for column, value in values.items():
        c, kind = field(df, column)
        c = own(column) if column in df.columns else c
        (old, new), _ = coerce.same_kind([(c, kind), value])
        done[column] = F.when(coerce.missing(c, kind), new).otherwise(old)
    rows = df if found is None else df.alias("main").crossJoin(F.broadcast(found.alias("found")))
    return rows.select(*((done[c] if c in done else own(c)).alias(c) for c in df.columns), *(v.alias(c) for c, v in done.items() if c not in df.columns)) if done else df


@node("generateColumn")
def generate_column(x: Inputs) -> Output:
    """`column` from `expression`. Where a row fails, a column that is there keeps its value, a new one is null."""
    column, source = x.get("column", str, ""), x.get("expression", str, "")
    if not column:
        raise AnalysisError("generateColumn needs a column")
    v = formula.compile(source, x.main)
    if v.err is None:
        return Output(with_column(x.main, column, v.col))
    value = stopping(v.col, v.err, x.on_error)
    if column in x.main.columns:
        (old, new), _ = coerce.same_kind([field(x.main, column), (value, v.kind)])
        value = F.when(v.err.isNull(), new).otherwise(old)
    elif x.on_error != "stop":
        value = F.when(v.err.isNull(), value)
    columns = [(value if c == column else name(c)).alias(c) for c in dict.fromkeys([*x.main.columns, column])]
    return failing(x.main, with_column(x.main, column, value), v.err, columns=columns)


@node("filterRows")
def filter_rows(x: Inputs) -> Output:
    """Rows where `expression` is true, all where it is empty. Rows that fail are dropped and kept as errors."""
    source = x.get("expression", str, "").strip()
    if not source:
        return Output(x.main)
    v = formula.compile(source, x.main)
    if v.err is None:
        return Output(x.main.filter(v.bare if v.bare is not None else coerce.truthy(*v.pair())))
    keep = stopping(coerce.truthy(*v.pair()), v.err, x.on_error)
    whole = keep if x.on_error == "stop" else v.err.isNull() & keep
    return failing(x.main, x.main.filter(whole), v.err, kept=whole)


@node("regexExtract")
def regex_extract(x: Inputs) -> DataFrame:
    """The first match of `pattern` in `column`, its first group if there is one; null without a match. Back references and look-around are refused."""
    column, pattern = x.get("column", str, ""), x.get("pattern", str, "")
    if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]", pattern):
        raise AnalysisError(f"regexExtract: {pattern!r} uses a back reference or look-around")
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise AnalysisError(f"regexExtract: {pattern!r}: {e}") from None
    java = pattern.replace("(?P<", "(?<")
    found = lambda c: F.when(c.rlike(java), F.regexp_extract(c, java, min(groups, 1)))
    return mapped(x, found, x.get("targetColumn", str) or f"{column}_extracted")


@node("splitColumn")
def split_column(x: Inputs) -> DataFrame:
    """Parts of `column` between a literal `delimiter`, stripped, into `targetColumns`; null where parts lack."""
    column, delimiter, df = x.get("column", str, ""), x.get("delimiter", str) or ",", x.main
    if column not in df.columns:
        return df
    # a Java pattern ends a quotation at \E, so each such pair is quoted apart
    parts = F.split(text(*field(df, column)), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    for i, target in enumerate(x.get("targetColumns", list, [])):
        df = with_column(df, target, coerce.strip(F.get(parts, F.lit(i))))
    return df


@node("mergeColumn")
def merge_column(x: Inputs) -> DataFrame:
    """The texts of `columns` with `separator` between them; nulls are passed over."""
    values = [text(*field(x.main, c)).cast("string") for c in x.get("columns", list, [])]
    return with_column(x.main, x.get("targetColumn", str) or "merged", F.concat_ws(x.get("separator", str, " "), *values))


def title(c: Column) -> Column:
    """Each run of letters, digits and underscores with a capital, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.transform(runs, capital), "")


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.char_length(c)))


OPERATIONS = {"upper": F.upper, "lower": F.lower, "trim": coerce.strip, "title": title, "capitalize": capital}


@node("stringTransform")
def string_transform(x: Inputs) -> DataFrame:
    """`column` after `operation`: upper, lower, trim, title or capitalize; others leave it as it is."""
    f = OPERATIONS.get(x.get("operation", str) or "trim")
    return mapped(x, f) if f else x.main


@node("mapValues")
def map_values(x: Inputs) -> DataFrame:
    """`column` through `mapping` by its text; else `default`, or the value itself where that is absent."""
    column, mapping, default = x.get("column", str, ""), x.get("mapping", dict, {}), x.config.get("default")
    if column not in x.main.columns:
        return x.main
    c, kind = field(x.main, column)
    as_text = lambda v: v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v:g}"
    hit = F.create_map(*(F.lit(y) for k, v in mapping.items() for y in (k, as_text(v))))[text(c, kind)] if mapping else F.lit(None).cast("string")
    return with_column(x.main, column, F.coalesce(hit, F.lit(as_text(default)) if default is not None else text(c, kind)))


def leaves(c: Column, t: T.DataType, path: str, separator: str) -> list[Column]:
    if isinstance(t, T.StructType):
        return [leaf for f in t.fields for leaf in leaves(c.getField(f.name), f.dataType, f"{path}{separator}{f.name}", separator)]
    return [c.alias(path)]


@node("flattenJSON")
def flatten_json(x: Inputs) -> DataFrame:
    """The fields of the struct `column`, at any depth, as columns of their own; arrays and scalars stay whole.

    A map's keys are found first. A text is read as JSON where `schema` gives its type, else it is left alone.
    """
    column, separator, df = x.get("column", str, ""), x.get("separator", str) or ".", x.main
    if column not in df.columns:
        return df
    c, t = name(column), df.schema[column].dataType
    if isinstance(t, T.StringType) and x.get("schema", str):
        t = T._parse_datatype_string(x.get("schema", str))
        c = F.from_json(c, t)
    if isinstance(t, T.MapType):
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(c))).distinct().limit(int(df.sparkSession.conf.get("spark.sql.pivotMaxValues")) + 1).collect())
        if len(keys) > int(df.sparkSession.conf.get("spark.sql.pivotMaxValues")):
            raise AnalysisError(f"flattenJSON: {column!r} has too many keys for columns")
        found = [leaf for k in keys for leaf in leaves(c[k], t.valueType, f"{column}{separator}{k}", separator)]
    elif isinstance(t, T.StructType):
        found = leaves(c, t, column, separator)
    else:
        return df
    return df.select(*(name(k) for k in df.columns if k != column), *found)


def rule(df: DataFrame, column: str, kind_: str, value: str) -> Column:
    """Whether a row keeps a rule; never null. Kinds that aren't known are kept by all."""
    c, kind = field(df, column)
    number = coerce.try_number(c, kind, trim=True)
    limit = F.coalesce(coerce.parse(F.trim(F.lit(value))), F.lit(0.0))
    if kind_ == "notNull":
        return ~coerce.missing(c, kind)
    if kind_ == "min":
        return F.coalesce(number >= limit, F.lit(False))
    if kind_ == "max":
        return F.coalesce(number <= limit, F.lit(False))
    if kind_ == "enum":
        return F.coalesce(text(c, kind).isin(*(v.strip() for v in value.split(","))), F.lit(False))
    if kind_ == "regex":
        return F.coalesce(text(c, kind).rlike(value), F.lit(False))
    return F.lit(True)


@node("validateSchema")
def validate_schema(x: Inputs) -> Output:
    """Rows that keep all `rules` (column, kind, value): notNull, min, max, enum, regex. Others are errors, by the first rule they break."""
    rules = [r for r in x.get("rules", list, []) if isinstance(r, dict)]
    if not rules:
        return Output(x.main)
    kept = [rule(x.main, r.get("column", ""), r.get("kind", ""), str(r.get("value", ""))) for r in rules]
    said = [F.lit(f'validateSchema: column "{r.get("column", "")}" failed rule "{r.get("kind", "")}"') for r in rules]
    message = F.coalesce(*(F.when(~k, s) for k, s in zip(kept, said, strict=True)))
    if x.on_error == "stop":
        return Output(x.main.filter(stopping(F.lit(True), message, "stop")))
    whole = kept[0]
    for k in kept[1:]:
        whole = whole & k
    return failing(x.main, x.main.filter(whole), message, kept=whole)
