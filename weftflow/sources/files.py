"""Files as DataFrames: delimited text, JSON documents, JSON lines, and what Spark reads by itself.

Formats are told by a file's name and first lines; only those reach the driver. Own readers are added to READERS.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import name
from . import ranges

#: Delimiters that are tried, in order.
DELIMITERS = (",", "\t", ";", "|")
#: A quoted field, from the field's first character on; the last one may go on behind the lines at hand.
QUOTED = re.compile(rf'(?:\A|(?<=[\n{"".join(DELIMITERS)}]))"(?:[^"]++|"")*+(?:"|\Z)')
#: Fields under which a JSON document may keep its rows, in order.
ENVELOPES = ("data", "items", "results", "rows", "records")
#: Rows of a preview.
PREVIEW_ROWS = 200
#: How surely a name tells a format.
SUFFIXES = {".csv": ("csv", 0.95), ".tsv": ("csv", 0.9), ".json": ("json", 0.95), ".ndjson": ("ndjson", 0.95), ".jsonl": ("ndjson", 0.95), ".parquet": ("parquet", 0.95), ".orc": ("orc", 0.95)}


def first_lines(spark: SparkSession, path: str, n: int = 5) -> list[str]:
    return [r[0] for r in spark.read.text(path).head(n)]


def detect_delimiter(lines: list[str]) -> str:
    """The candidate on which most lines agree, weighted by how often it stands in a line; a comma where none does. What is within quotes doesn't count."""
    best, most = ",", 0
    lines = QUOTED.sub("", "\n".join(lines)).split("\n")
    for d in DELIMITERS:
        counts = Counter(line.count(d) for line in lines if line.count(d))
        if counts:
            n, lines_with = max(counts.items(), key=lambda x: (x[1], x[0]))
            if lines_with * (n + 1) > most:
                best, most = d, lines_with * (n + 1)
    return best


def detect_format(path: str, lines: list[str]) -> str:
    """csv, json, ndjson, parquet or orc; ValueError where nothing fits."""
    suffix = (re.search(r"\.[a-z]+$", path.lower().rstrip("/")) or [""])[0]
    head = "\n".join(lines).lstrip()
    delimited = bool(lines) and any(d in lines[0] for d in DELIMITERS)
    scores = Counter({"csv": 0.4 if suffix == ".txt" and delimited else 0.1 if suffix == ".txt" else 0.3 if delimited else 0.0})
    if head[:1] in ("{", "["):
        scores["json"] = 0.5
    if head[:1] == "{" and len(lines) > 1:
        scores["ndjson"] = 0.55 if all(x.strip().startswith("{") and x.strip().endswith("}") for x in lines if x.strip()) else 0.35
    if suffix in SUFFIXES:
        kind, score = SUFFIXES[suffix]
        scores[kind] = max(scores[kind], score)
    kind, score = max(scores.items(), key=lambda x: x[1])
    if not score:
        raise ValueError(f"the format of {path} isn't known")
    return kind


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, preserve_empty: bool = False, multi_line: bool = True, split: bool = True, keep_returns: bool = False) -> DataFrame:
    """Delimited text, all columns texts. Short rows are filled with nulls, surplus fields dropped; of equal headers the last counts.

    Line feeds within quotes are read, and files are split over tasks all the same: a pass when this is called finds where records
    begin (see `ranges`); without `split` a file is one task, and nothing runs beforehand. `multi_line=False` saves the pass for files that are known to have a record on each line. Lines end with a line feed; a carriage
    return before one goes, also within quotes, where split files keep it with `keep_returns`. `preserve_empty` turns nulls into "".
    """
    lines = first_lines(spark, path)
    sep = delimiter or detect_delimiter(lines)
    first = next(csv.reader((x + "\n" for x in lines) if multi_line else lines[:1], delimiter=sep), [])
    names = first if header else [f"column_{i + 1}" for i in range(len(first))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # without a character that escapes the quote's escape Spark takes \0 for it, and drops it from texts
    options = {"sep": sep, "multiLine": str(multi_line).lower(), "escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "PERMISSIVE"}
    if multi_line and split:
        records = ranges.csv_records(spark, path, sep)
        kept = records.filter(~F.col("leads")) if header else records
        text = F.regexp_replace("record", r"\r\z" if keep_returns else r"\r(?=\n|\z)", "")
        rows = kept.select(text.alias("r")).filter("r <> ''").select(F.from_csv("r", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options | {"lineSep": "\n"}).alias("v")).select("v.*")
    else:
        rows = spark.read.schema(schema).options(**options).option("header", header).option("enforceSchema", True).csv(path)
    last = {n: i for i, n in enumerate(names)}
    value = lambda i: F.coalesce(F.col(f"c{i}"), F.lit("")) if preserve_empty else F.col(f"c{i}")
    return rows.select(*(value(i).alias(n) for n, i in last.items()))


def unwrap(df: DataFrame) -> DataFrame:
    """The rows of a JSON document: those of the first envelope that is an array, else the document itself."""
    for field in ENVELOPES:
        if field in df.columns and isinstance(df.schema[field].dataType, T.ArrayType):
            items = df.select(F.explode(name(field)).alias("value"))
            return items.select("value.*") if isinstance(items.schema["value"].dataType, T.StructType) else items
    return df


def item_type(spark: SparkSession, schema: str | T.StructType) -> T.StructType:
    """The type of the rows of documents of a type."""
    found = spark.createDataFrame([], schema).schema
    for field in ENVELOPES:
        kind = next((f.dataType for f in found.fields if f.name == field), None)
        if isinstance(kind, T.ArrayType):
            return kind.elementType if isinstance(kind.elementType, T.StructType) else T.StructType([T.StructField("value", kind.elementType)])
    return found


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents, one for each file: arrays give their items, objects their envelope or themselves, scalars a column `value`.

    Documents are split over tasks (see `ranges`); a document that is one object without envelope is one row. A `schema` of the
    documents, with their envelope if they have one, saves the pass over all items that infers it.
    """
    items = ranges.json_items(spark, path, ENVELOPES)
    scalar = F.from_json(F.concat(F.lit("["), F.col("item"), F.lit("]")), "array<string>")[0]
    if schema:
        kind = item_type(spark, schema)
        if kind.names == ["value"] and not isinstance(kind["value"].dataType, T.StructType):
            is_object = F.startswith("item", F.lit("{"))
            return items.select(F.when(is_object, F.from_json("item", kind)["value"]).otherwise(scalar.cast(kind["value"].dataType)).alias("value"))
        return items.select(F.from_json("item", kind).alias("v")).select("v.*")
    objects, others = items.filter(F.startswith("item", F.lit("{"))), items.filter(~F.startswith("item", F.lit("{")))
    kind = spark.read.json(objects.rdd.map(lambda r: r[0])).schema
    values = others.select(scalar.alias("value"))
    if not kind.fields:
        return values
    rows = objects.select(F.from_json("item", kind).alias("v")).select("v.*")
    return rows if others.isEmpty() else rows.unionByName(values, allowMissingColumns=True) if "value" not in rows.columns else rows.withColumn("value", F.col("value").cast("string")).unionByName(values, allowMissingColumns=True)


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A row for each line; blank and malformed lines are passed over. A `schema` saves the pass that infers it, and files of other fields are read alike."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def stream_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", header: bool = True, preserve_empty: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder, as `read_csv` reads them; the columns are named beforehand, one record stands on each line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", header).option("sep", delimiter).option("escape", '"').option("mode", "PERMISSIVE")
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(path)
    return rows.select(*(F.coalesce(name(c), F.lit("")).alias(c) for c in columns)) if preserve_empty else rows


def stream_json(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the items of the JSON documents that arrive in a folder, as `read_json` gives them. Each document is read whole by one task, as a stream has no second pass."""
    reader = spark.readStream.schema(schema).option("multiLine", True)
    return unwrap((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path))


def stream_ndjson(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder; blank and malformed lines are passed over."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv, "json": read_json, "ndjson": read_ndjson,
    "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path),
}


def preview(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS, format: str | None = None) -> DataFrame:  # noqa: A002
    """The first rows of a file, without a pass over all of it where the format allows it: only JSON documents are read in ranges."""
    kind = format or told(spark, path)
    return read(spark, path, kind, **({"split": False} if kind == "csv" else {})).limit(rows)


def formats() -> list[str]:
    return sorted(READERS)


def told(spark: SparkSession, path: str) -> str:
    """The format of a file, from its name and first lines."""
    suffix = path.lower().rstrip("/").rpartition(".")[2]
    return suffix if suffix in ("parquet", "orc") else detect_format(path, first_lines(spark, path))


def read(spark: SparkSession, path: str, format: str | None = None, **options: object) -> DataFrame:  # noqa: A002
    """A file or folder in a format of READERS, told from its name and first lines where none is given."""
    format = format or told(spark, path)  # noqa: A001
    if format not in READERS:
        raise ValueError(f"there is no reader for {format!r}; there are {', '.join(formats())}")
    return READERS[format](spark, path, **options)
