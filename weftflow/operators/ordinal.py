"""Row numbers over a whole table without gathering it in one task.

Rows of a plain scan of parquet files are numbered by the scan itself: Spark tells each row's file and place in it, and a count that
reads no column but the files' footers tells how many rows stand before each file. Other rows are written first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import name
from .shared import cut

#: Files up to whose number their counts are broadcast, about 200 bytes each; beyond it Spark picks the join.
MOST_FILES = 100_000
#: What a plan is made of that gives each row of its files once, in any columns.
PLAIN = {"Project", "SubqueryAlias"}


def is_plain(df: DataFrame) -> bool:
    """Whether the rows are those of a table's files, neither filtered nor moved."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in PLAIN and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def by_files(df: DataFrame) -> tuple[DataFrame, int] | None:
    """The rows of a plain scan with `__i`, by the names of the files and the order within them; None for other rows and formats that don't tell a row's place."""
    if not is_plain(df):
        return None
    try:
        placed = df.withColumns({"__f": F.col("_metadata.file_path"), "__r": F.col("_metadata.row_index")})
    except AnalysisException:  # only parquet has row_index
        return None
    sizes = df.select(F.col("_metadata.file_path").alias("__f")).groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__f", (F.sum("__n").over(Window.orderBy("__f")) - F.col("__n")).alias("__before"))
    files, total = sizes.agg(F.count(F.lit(1)), F.sum("__n")).first()
    rows = placed.join(F.broadcast(before) if files <= MOST_FILES else before, "__f")
    return rows.withColumn("__i", F.col("__before") + F.col("__r")).drop("__f", "__r", "__before"), total or 0


def with_ordinal(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """The rows with `__i`, counted from 0 in the order of the columns (without any, that of files and their rows, or as computed), and their number.

    Rows are dealt into ranges and numbered within each; only the ranges' sizes meet in one place. Ties are broken by the
    other columns' hash, which also parts ranges of a frequent value.
    """
    if not order and (found := by_files(df)):
        return found
    if order:
        by = [*(name(o).asc_nulls_last() for o in order), F.xxhash64(*(name(c) for c in df.columns)).asc()]
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    held = cut(df.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rows")
    sizes = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    # a row for each partition, so it may be broadcast whatever the table's size
    rows = held.join(F.broadcast(before), "__p").withColumn("__i", F.col("__before") + F.col("__r"))
    return rows.drop("__p", "__r", "__before"), total
