"""Nodes over several rows or inputs: joins, lookups, unions, grouping, pivots, order, sampling and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.coerce import field, name, text
from .base import AnalysisError, Inputs, node, place
from .ordinal import with_ordinal
from .shared import cut, drop

#: Standard deviations by which a random sample is drawn too large before it is cut.
SPARE = 7
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "cross": "cross"}


def same_key(l: tuple[Column, str], r: tuple[Column, str]) -> Column:
    """Null keys are equal; keys of different kinds compare as texts."""
    (a, b), _ = ((l[0], r[0]), "") if l[1] == r[1] else ((text(*l).cast("string"), text(*r).cast("string")), "")
    return a.eqNullSafe(b)


@node("join")
def join(x: Inputs) -> DataFrame:
    """Rows of the input and of the port `right` with equal keys; `joinType` is inner, left, right, full or cross.

    Columns of the right side whose names the left side has get `rightPrefix`; where a row has no left side, they fill
    the left side's columns instead. Without keys all rows match. Spark picks the strategy, from sizes and at run time.
    """
    left, right = x.main, x.port("right")
    kind, prefix = x.get("joinType", str) or "inner", x.get("rightPrefix", str) or "right_"
    if kind not in JOINS:
        raise AnalysisError(f"join: there is no type {kind!r}")
    lk, rk = x.get("leftKeys", list, []), x.get("rightKeys", list, [])
    if len(lk) != len(rk):
        raise AnalysisError("join: leftKeys and rightKeys differ in number")
    how = JOINS[kind]
    a = left.select(*(name(c).alias(f"l{i}") for i, c in enumerate(left.columns)), F.lit(True).alias("in_left"))
    b = right.select(*(name(c).alias(f"r{i}") for i, c in enumerate(right.columns)), F.lit(True).alias("in_right"))
    of = lambda df, tag, c: (F.col(f"{tag}{df.columns.index(c)}"), field(df, c)[1]) if c in df.columns else field(df, c)
    keys = [] if how == "cross" else [same_key(of(left, "l", p), of(right, "r", q)) for p, q in zip(lk, rk, strict=True)]
    met = a.join(b, reduce(lambda p, q: p & q, keys), how) if keys else a.crossJoin(b) if how in ("cross", "inner") else a.join(b, F.lit(True), how)
    alone = F.col("in_left").isNull()
    out: dict[str, Column] = {}
    for c in left.columns:
        value = F.col(f"l{left.columns.index(c)}")
        if c in right.columns and how in ("right", "full"):
            (mine, theirs), _ = coerce.same_kind([of(left, "l", c), of(right, "r", c)])
            value = F.when(alone, theirs).otherwise(mine)
        out[c] = value
    for c in right.columns:
        value = of(right, "r", c)[0]
        if c in left.columns:
            out[prefix + c] = F.when(~F.coalesce(alone, F.lit(False)), value) if how in ("right", "full") else value
        else:
            out[c] = value
    return met.select(*(v.alias(c) for c, v in out.items()))


@node("lookupEnrich")
def lookup_enrich(x: Inputs) -> DataFrame:
    """`fields` of the row at the port `reference` whose `referenceKey` equals `key`; of several rows the last by `orderBy`.

    Without such a row fields keep the values they have, or are null. The reference is aggregated by key before the join.
    """
    df, ref = x.main, x.port("reference")
    key, fields = x.get("key", str, ""), x.get("fields", list, [])
    ref_key = x.get("referenceKey", str) or key
    value = F.struct(*(field(ref, f)[0].alias(f"f{i}") for i, f in enumerate(fields)))
    order = x.get("orderBy", list, [])
    last = F.max_by(F.col("value"), F.struct(*(F.col(f"o{i}") for i in range(len(order)))) if order else F.col("at"))
    k, kind = field(ref, ref_key)
    rows = ref.select(k.alias("k"), value.alias("value"), *(name(o).alias(f"o{i}") for i, o in enumerate(order)), F.monotonically_increasing_id().alias("at"))
    known = rows.groupBy("k").agg(last.alias("v"), F.lit(True).alias("hit"))
    mine = df.select(*(name(c).alias(f"m{i}") for i, c in enumerate(df.columns)))
    own = (F.col(f"m{df.columns.index(key)}"), field(df, key)[1]) if key in df.columns else field(df, key)
    met = mine.join(known, same_key(own, (F.col("k"), kind)), "left")
    out = {c: F.col(f"m{i}") for i, c in enumerate(df.columns)}
    for i, f in enumerate(fields):
        (new, old), _ = coerce.same_kind([(F.col(f"v.f{i}"), field(ref, f)[1]), (out.get(f, F.lit(None)), field(df, f)[1])])
        out[f] = F.when(F.col("hit"), new).otherwise(old)
    return met.select(*(v.alias(c) for c, v in out.items()))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows, columns matched by name; where kinds differ the column becomes a double or a text."""
    if len(parts) == 1:
        return parts[0]
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    as_one = {c: coerce.same_kind([field(p, c) for p in parts])[0] for c in names}
    return reduce(DataFrame.unionAll, (p.select(*(as_one[c][i].alias(c) for c in names)) for i, p in enumerate(parts)))


@node("union")
def union(x: Inputs) -> DataFrame:
    """The input's rows and those of the port `b`; with `distinct` each different row once."""
    both = union_all([x.main, *([x.ports["b"]] if "b" in x.ports else [])])
    return both.dropDuplicates() if x.get("distinct", bool, False) else both


def aggregate(func: str, c: Column, kind: str, at: Column) -> Column:
    """One of count, sum, avg, min, max (over what are numbers, 0 without any), first and last (by `at`)."""
    number = coerce.try_number(c, kind, trim=True)
    known = {
        "count": lambda: F.count(F.lit(1)), "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)), "avg": lambda: F.coalesce(F.avg(number), F.lit(0.0)),
        "min": lambda: F.coalesce(F.min(number), F.lit(0.0)), "max": lambda: F.coalesce(F.max(number), F.lit(0.0)), "first": lambda: F.min_by(c, at), "last": lambda: F.max_by(c, at),
    }
    if func not in known:
        raise AnalysisError(f"there is no aggregate function {func!r}")
    return known[func]()


def ordered(x: Inputs, funcs: list[str]) -> tuple[DataFrame, Column]:
    """The input with what orders it, if a function asks for it."""
    if not {"first", "last"} & set(funcs):
        return x.main, F.lit(0)
    return x.main.withColumn("__at", place(x)), F.col("__at")


@node("groupByAggregate")
def group_by(x: Inputs) -> DataFrame:
    """`aggregations` (column, func, as) by `keys`; null is a key like others. Without keys one row, none for an empty input."""
    wanted = [a for a in x.get("aggregations", list, []) if isinstance(a, dict)]
    df, at = ordered(x, [a.get("func", "") for a in wanted])
    keys = x.get("keys", list, [])
    found = [aggregate(a.get("func", ""), *field(x.main, a.get("column", "")), at).alias(a.get("as") or f"{a.get('func', '')}_{a.get('column', '')}") for a in wanted]
    if keys:
        by = [field(x.main, k)[0].alias(k) for k in keys]
        return df.groupBy(*by).agg(*found) if found else df.select(*by).distinct()
    return df.agg(*found, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")


@node("deduplicate")
def deduplicate(x: Inputs) -> DataFrame:
    """The first row by `orderBy` for each combination of `keys`; without keys each different row once.

    The first rows are aggregated before the shuffle, so a frequent key costs a row for each task. With `within` (a column of times
    and a delay) rows of a key that lie further apart than the delay are apart, in tables as in streams: a stream gives the first row
    once its watermark has passed the delay, and keeps a row for each open key. Over a stream without `orderBy` the row that arrives first goes on at once.
    """
    df, keys, within = x.main, x.get("keys", list, []), x.get("within", list)
    if df.isStreaming and not x.get("orderBy", list):
        return df.dropDuplicatesWithinWatermark([k for k in keys if k in df.columns]) if keys else df.dropDuplicatesWithinWatermark()
    if not keys:
        return df.dropDuplicates()
    apart = [F.session_window("near", within[1])] if within else []
    row = F.struct(*(name(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
    near = [name(within[0]).alias("near")] if within else []
    rows = df.select(*(field(df, k)[0].alias(f"k{i}") for i, k in enumerate(keys)), row.alias("row"), place(x).alias("at"), *near)
    first = rows.groupBy(*(f"k{i}" for i in range(len(keys))), *apart).agg(F.min_by("row", "at").alias("row"))
    return first.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)))


@node("pivot")
def pivot(x: Inputs) -> DataFrame:
    """A row for each `indexColumn`, a column for each text of `pivotColumn`, cells by `aggFunc` over `valueColumn`; empty cells are null.

    Give `values` to save the job that looks for them. A null's column is <nil>.
    """
    index, by, value = (x.get(k, str, "") for k in ("indexColumn", "pivotColumn", "valueColumn"))
    if not (index and by and value):
        return x.main
    func = x.get("aggFunc", str) or "first"
    df, at = ordered(x, [func])
    rows = df.withColumn("__by", F.coalesce(text(*field(x.main, by)).cast("string"), F.lit("<nil>")))
    values = x.get("values", list)
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        values = sorted(r[0] for r in rows.select("__by").distinct().limit(most + 1).collect())
        if len(values) > most:
            raise AnalysisError(f"pivot: {by!r} has more than {most} values")
    cells = rows.groupBy(field(x.main, index)[0].alias("__index")).pivot("__by", values).agg(aggregate(func, *field(x.main, value), at))
    own = F.col("__index").alias(index)
    if index in values:  # the cell overwrites the index
        (cell, old), _ = coerce.same_kind([(name(index), coerce.kind_of(cells.schema[index].dataType)), (F.col("__index"), field(x.main, index)[1])])
        own = F.coalesce(cell, old).alias(index)
    return cells.select(own, *(name(v) for v in values if v != index))


@node("unpivot")
def unpivot(x: Inputs) -> DataFrame:
    """A row for each of `valueColumns`: `idColumns`, the column's name and its value, nulls too. Mixed kinds become doubles or texts."""
    ids, values = x.get("idColumns", list, []), x.get("valueColumns", list, [])
    called = x.get("nameField", str) or "variable", x.get("valueField", str) or "value"
    if not values:
        return x.main.select(*(field(x.main, i)[0].alias(i) for i in ids), F.lit("").alias(called[0]), F.lit(None).cast("string").alias(called[1])).limit(0)
    cols, kind = coerce.same_kind([field(x.main, v) for v in values])
    if kind == "null":
        cols = [c.cast("string") for c in cols]
    pairs = F.array(*(F.struct(F.lit(v).alias("n"), c.alias("v")) for v, c in zip(values, cols, strict=True)))
    out = x.main.select(*(field(x.main, i)[0].alias(i) for i in ids), F.explode(pairs).alias("__pair"))
    return out.select(*(name(i) for i in ids), F.col("__pair.n").alias(called[0]), F.col("__pair.v").alias(called[1]))


def sort_keys(df: DataFrame, keys: list) -> list[Column]:
    """Ascending with nulls last, descending with nulls first; texts that spell numbers come first, as numbers."""
    out = []
    for k in keys:
        c, kind = field(df, k.get("column", ""))
        for part in [coerce.parse(c), c] if kind == "string" else [c]:
            out.append(part.desc_nulls_first() if k.get("desc") else part.asc_nulls_last())
    return out


@node("sort")
def sort(x: Inputs) -> DataFrame:
    """All rows by `keys` (column, desc)."""
    keys = sort_keys(x.main, [k for k in x.get("keys", list, []) if isinstance(k, dict)])
    return x.main.orderBy(*keys) if keys else x.main


def random_rows(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """Exactly `size` rows (all, if fewer), those with the smallest of random numbers, whatever the size. `__m` tells rows of one number apart.

    Rows up to a number that so many hardly fail to reach are written, about SPARE standard deviations too many. Only the numbers of
    these surplus rows, about the square root of `size`, meet in one task, which finds where to cut; a filter does the rest.
    """
    n, spare = rows.count(), SPARE
    drawn = rows.withColumn("__r", F.rand(seed))
    while True:
        most = size + spare * size**0.5 + spare**2
        few = cut(drawn.filter(F.col("__r") * n <= most), "sample")
        surplus = few.count() - size
        if surplus >= 0 or most >= n:
            break
        drop(few)
        spare *= 4
    if surplus <= 0:
        return few.drop("__r")
    last = few.select("__r", "__m").orderBy(F.desc("__r"), F.desc("__m")).limit(surplus).agg(F.min(F.struct("__r", "__m")).alias("x")).first()["x"]
    return few.filter((F.col("__r") < last["__r"]) | (F.col("__r") == last["__r"]) & (F.col("__m") < last["__m"])).drop("__r")


@node("sampling")
def sampling(x: Inputs) -> DataFrame:
    """`size` rows: `first` by `orderBy`, `random` by `seed`, or `systematic`, each so many rows in that order. All where there are no more.

    Random rows come in the order that the input has (see `random_rows`).
    """
    size, method = int(x.get("size", (int, float), 0)), x.get("method", str) or "first"
    order = [name(k).asc_nulls_last() for k in x.get("orderBy", list, [])]
    if size <= 0:
        return x.main
    if method == "random":
        rows = x.main.withColumn("__at", place(x)).withColumn("__m", F.monotonically_increasing_id())
        return random_rows(rows, size, int(x.get("seed", (int, float), 0))).orderBy("__at").drop("__at", "__m")
    if method == "systematic":
        rows, n = with_ordinal(x.main, x.get("orderBy", list, []))
        if size >= n:
            return rows.drop("__i")
        step = n // size
        return rows.filter((F.col("__i") % step == 0) & (F.col("__i") < step * size)).drop("__i")
    return (x.main.orderBy(*order) if order else x.main).limit(size)
