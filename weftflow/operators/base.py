"""What a node of a pipeline is: a function from DataFrames and a configuration to DataFrames, looked up by its type."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import name
from .shared import work_dir

#: Rows of a batch that a node in Python sees, at most.
BATCH_ROWS = 1000


class AnalysisError(ValueError):
    """A pipeline that can't be bound: a wrong configuration, formula or graph."""


@dataclass
class Inputs:
    """The DataFrames at a node's ports and its configuration; `on_error` is stop, skip or collect."""

    main: DataFrame
    ports: dict[str, DataFrame] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)
    on_error: str = "skip"

    def get(self, key: str, kind: type | tuple[type, ...], default: Any = None) -> Any:
        """A configured value; one of another type counts as absent."""
        found = self.config.get(key)
        return found if isinstance(found, kind) and not (isinstance(found, bool) and kind is not bool) else default

    def port(self, key: str) -> DataFrame:
        if key not in self.ports:
            raise AnalysisError(f"nothing is connected to the port {key!r}")
        return self.ports[key]


@dataclass
class Output:
    """The rows that go on, and those that failed as (row struct, message string), lazily.

    Nodes whose rows can fail also tell the `message` of a row of their input, null where it doesn't fail, and what both tables come
    from in one pass: `judged`, the output's columns, `__row`, `__message` and `__kept`, whether the row goes on.
    """

    df: DataFrame
    errors: DataFrame | None = None
    message: Column | None = None
    judged: DataFrame | None = None


NODES: dict[str, Callable[[Inputs], Output]] = {}


def node(type_: str) -> Callable[[Callable[[Inputs], Output | DataFrame]], Callable[[Inputs], Output]]:
    """Register a node type; own nodes are added the same way."""

    def add(f: Callable[[Inputs], Output | DataFrame]) -> Callable[[Inputs], Output]:
        def run(inputs: Inputs) -> Output:
            found = f(inputs)
            return Output(found) if isinstance(found, DataFrame) else found

        NODES[type_] = run
        return run

    return add


def batch_node(type_: str, schema: Callable[[Inputs], str], rows: int = BATCH_ROWS) -> Callable[[Callable], Callable[[Inputs], Output]]:
    """Register a node that turns rows into rows in Python: a generator from Arrow batches of at most `rows` rows and the configuration to batches.

    It runs in each task over the task's batches, one after the other, so what it keeps between them is that task's own; it must
    not rely on how rows are dealt. `schema` tells the columns that its batches have, for the node's inputs.
    """

    def add(f: Callable[[Iterator[pa.RecordBatch], dict[str, Any]], Iterator[pa.RecordBatch]]) -> Callable[[Inputs], Output]:
        def run(x: Inputs) -> DataFrame:
            config = dict(x.config)

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return f((b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)), config)

            return x.main.mapInArrow(each, schema(x))

        return node(type_)(run)

    return add


def types() -> list[str]:
    return sorted(NODES)


def error_rows(df: DataFrame, message: Column) -> DataFrame:
    bad = df.withColumn("__message", message).filter(F.col("__message").isNotNull())
    return bad.select(F.struct(*(name(c).alias(c) for c in df.columns)).alias("row"), F.col("__message").alias("message"))


def failing(df: DataFrame, out: DataFrame, message: Column, kept: Column | None = None, columns: list[Column] | None = None) -> Output:
    """The output of a node over `df` whose rows can fail: `out` are the rows that go on. `columns` are its columns over df, df's own by default; all rows are `kept` by default."""
    row = F.struct(*(name(c).alias(c) for c in df.columns))
    marks = [F.when(message.isNotNull(), row).alias("__row"), message.alias("__message"), (F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))).alias("__kept")]
    return Output(out, error_rows(df, message), message, df.select(*(columns or [name(c).alias(c) for c in df.columns]), *marks))


def parted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that go on and the failed ones, from one write of what a node has judged: its parts are read apart."""
    part = F.when(F.col("__message").isNull(), 0).when(F.col("__kept"), 1).otherwise(2)
    path = work_dir(judged.sparkSession, "judged")
    marked = judged.filter(F.col("__kept") | F.col("__message").isNotNull()).withColumn("__part", part)
    marked.write.partitionBy("__part").parquet(path)
    whole = judged.sparkSession.read.schema(marked.schema).parquet(path)
    good = whole.filter("__part < 2").drop("__row", "__message", "__kept", "__part")
    return good, whole.filter("__part > 0").select(F.col("__row").alias("row"), F.col("__message").alias("message"))


def stopping(value: Column, message: Column | None, on_error: str) -> Column:
    """The value; under `stop` a row's message is raised when the row is computed."""
    if message is None or on_error != "stop":
        return value
    return F.when(message.isNotNull(), F.raise_error(message)).otherwise(value)


def place(inputs: Inputs) -> Column:
    """What orders rows where their order matters: the configured columns, or else the order in which Spark reads them.

    The latter follows files and a sort just before, but is arbitrary after a shuffle: give `orderBy` for results that
    don't depend on it.
    """
    keys = inputs.get("orderBy", list, [])
    if keys:
        return F.struct(*(name(k).alias(f"o{i}") for i, k in enumerate(keys)))
    return F.monotonically_increasing_id()
