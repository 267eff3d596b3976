"""Pipelines over streams: documents whose nodes need neither order nor the whole input."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import AnalysisError
from ..plans.pipeline import Pipeline

#: Nodes that work row by row, and those that keep state which a watermark bounds.
ROWWISE = {"input", "output", "selectColumns", "renameColumns", "typeCast", "generateColumn", "filterRows", "regexExtract", "splitColumn", "mergeColumn", "stringTransform", "mapValues", "flattenJSON", "validateSchema", "unpivot", "union"}
STATEFUL = {"groupByAggregate", "join", "deduplicate"}


def bind_stream(document: str | dict[str, Any], sources: dict[str, DataFrame], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The output of a pipeline over streams and tables. Grouping and joining streams need a `watermark` (column, delay), which drops late rows.

    First and last values take an `orderBy`, so that they don't depend on the order of arrival. Duplicates are sought within the
    watermark's delay: by `orderBy` the first row of a key goes on once the watermark has passed it, else the first to arrive.
    """
    plan = Pipeline.parse(document)
    for n in plan.nodes:
        ordered = bool(n.config.get("orderBy"))
        funcs = {a.get("func") for a in n.config.get("aggregations", []) if isinstance(a, dict)}
        if not n.disabled and (n.type not in ROWWISE | STATEFUL or funcs & {"first", "last"} and not ordered or n.type == "union" and n.config.get("distinct") or n.type == "fillMissingValues"):
            raise AnalysisError(f"{n.id}: {n.type} needs order or the whole input, which a stream hasn't")
        if n.type in STATEFUL and watermark is None:
            raise AnalysisError(f"{n.id}: {n.type} over a stream needs a watermark")
        if n.type == "deduplicate" and ordered:
            n.config.setdefault("within", list(watermark))
    late = lambda df: df.withWatermark(*watermark) if watermark and df.isStreaming and watermark[0] in df.columns else df
    return plan.bind({k: late(v) for k, v in sources.items()}).output()


def write_stream(df: DataFrame, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A writer that starts again where it stopped; set its format or foreachBatch and start it."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
