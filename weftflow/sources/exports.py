"""Six text formats as a DataFrame of lines, which Spark writes as text files: csv, json, markdown, sql, xml and yaml.

Lines stand in the order of the rows; a heading comes in the first file and an ending in the last, so that the part files
in the order of their names are one document; JSON also comes as one document for each part. Own formats are added to FORMATS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.coerce import field, name, text
from ..operators.ordinal import with_ordinal

#: Rows of an INSERT statement.
BATCH = 500


def lines(df: DataFrame, *found: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in found], "line string").coalesce(1)


def values(df: DataFrame, columns: list[str], null: str) -> list[Column]:
    return [F.coalesce(text(*field(df, c)).cast("string"), F.lit(null)) for c in columns]


def csv_lines(df: DataFrame, columns: list[str], delimiter: str = ",", null: str = "") -> DataFrame:
    plain = lambda c: ~c.rlike(r'["\r\n]|^\s|^\\\.$') & ~c.contains(delimiter)
    cell = lambda c: F.when(plain(c), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    head = df.sparkSession.range(1).select(F.concat_ws(delimiter, *(cell(F.lit(c)) for c in columns)).alias("line")).coalesce(1)
    return head.unionAll(df.select(F.concat_ws(delimiter, *map(cell, values(df, columns, null))).alias("line")))


def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as the lines of one array; only the latest row is held back, since the last has no comma."""
    line = lambda texts: pa.record_batch([texts], ["line"])
    last = pa.array([], pa.string())
    yield line(pa.array(["["]))
    for batch in batches:
        if batch.num_rows:
            texts = pa.concat_arrays([last, batch.column(0)])
            last = texts.slice(len(texts) - 1)
            yield line(pc.binary_join_element_wise(texts.slice(0, len(texts) - 1), ",", ""))
    yield line(pa.concat_arrays([last, pa.array(["]"])]))


def json_lines(df: DataFrame, columns: list[str], pretty: bool = False, documents: bool = False) -> DataFrame:
    """One array of objects with all columns, nulls too. Brackets come with the first and the last row, so that they stay beside them however files are put together.

    With `documents` each partition is an array of its own, so nothing is counted, sorted or gathered: a table of any size makes
    as many documents as it has partitions. Their lines stay one document for each file as `write` puts them.
    """
    each = df.select(F.to_json(F.struct(*(name(c).alias(c) for c in df.columns)), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("j"))
    if documents:
        return each.mapInArrow(bracketed, "line string")
    rows, n = with_ordinal(each, [])
    if not n:
        return lines(df, "[", "]")
    first, last = F.col("__i") == 0, F.col("__i") == n - 1
    found = F.array(F.when(first, "["), F.concat("j", F.when(last, "").otherwise(",")), F.when(last, "]"))
    return rows.orderBy("__i").select(F.explode(F.array_compact(found)).alias("line"))


def escaped(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_lines(df: DataFrame, columns: list[str], null: str = "") -> DataFrame:
    tags = [c.translate(str.maketrans(" <>", "___")) for c in columns]
    cells = [F.concat(F.lit(f"    <{t}>"), escaped(v, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.lit(f"</{t}>")) for t, v in zip(tags, values(df, columns, null), strict=True)]
    return lines(df, "<rows>").unionAll(df.select(F.concat_ws("\n", F.lit("  <row>"), *cells, F.lit("  </row>")).alias("line"))).unionAll(lines(df, "</rows>"))


def yaml_lines(df: DataFrame, columns: list[str], null: str = "") -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), escaped(c, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")), F.lit('"'))
    cell = lambda c: F.when(c == "", "null").when(c.rlike(r"[:#{}\[\]&*!|>'\"%@`]|^\s|\s$"), quoted(c)).otherwise(c)
    return df.select(F.concat_ws("\n", F.lit("-"), *(F.concat(F.lit(f"  {c}: "), cell(v)) for c, v in zip(columns, values(df, columns, null), strict=True))).alias("line"))


def markdown_lines(df: DataFrame, columns: list[str], null: str = "") -> DataFrame:
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = lines(df, f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |")
    return head.unionAll(df.select(row([escaped(v, ("|", "\\|")) for v in values(df, columns, null)]).alias("line")))


def sql_lines(df: DataFrame, columns: list[str], table: str = "weftflow_export") -> DataFrame:
    """INSERT statements of BATCH rows each, a line for each statement."""

    def literal(c: Column, kind: str) -> Column:
        t = text(c, kind).cast("string")
        shown = F.upper(t) if kind == "boolean" else t if kind in ("long", "double") else F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(shown, F.lit("NULL"))

    row = F.concat(F.lit("  ("), F.concat_ws(", ", *(literal(*field(df, c)) for c in columns)), F.lit(")"))
    rows, _ = with_ordinal(df.select(row.alias("row")), [])
    named = ", ".join(f'"{c}"' for c in columns)
    batches = rows.groupBy(F.floor(F.col("__i") / BATCH).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("__i", "row"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), ",\n")
    return batches.orderBy("batch").select(F.concat(F.lit(f"INSERT INTO {table} ({named}) VALUES\n"), body, F.lit(";")).alias("line"))


FORMATS: dict[str, Callable[..., DataFrame]] = {"csv": csv_lines, "json": json_lines, "markdown": markdown_lines, "sql": sql_lines, "xml": xml_lines, "yaml": yaml_lines}


def export_lines(df: DataFrame, format: str, columns: list[str] | None = None, **options: object) -> DataFrame:  # noqa: A002
    """(line string) of the rows; columns that are missing are null."""
    if format not in FORMATS:
        raise ValueError(f"there is no format {format!r}; there are {', '.join(sorted(FORMATS))}")
    return FORMATS[format](df, columns or df.columns, **options)


def write(df: DataFrame, path: str, format: str, columns: list[str] | None = None, **options: object) -> None:  # noqa: A002
    """Write the lines as text files below `path`."""
    export_lines(df, format, columns, **options).write.option("maxRecordsPerFile", 0).text(path)  # a document isn't cut within
