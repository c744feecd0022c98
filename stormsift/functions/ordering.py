"""Places in a total order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.sources.io import kept

#: Rows that one task numbers, and tasks at most; beyond both, tasks hold more.
TASK_ROWS, MOST_TASKS = 100_000, 20_000
_LOW = (1 << 33) - 1  # monotonically_increasing_id: the task above, the row within it below these bits


def in_order(df: DataFrame, order: list[str | Column], name: str, cheap: bool = False) -> DataFrame:
    """df, written (unless few rows are cheap to make again), with its rows numbered from 0 by order in a column name.

    A few rows are numbered by one window. More are sorted by ranges, numbered within each task as they are written, and
    shifted by what stands before their task: one count for each task, so the table of shifts has at most MOST_TASKS rows.
    Equal rows of the order are numbered in any order.
    """
    df = df if cheap else kept(df)
    n = df.count()
    if n <= TASK_ROWS:
        return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))  # bounded: TASK_ROWS
    ranged = df.repartitionByRange(min(MOST_TASKS, -(-n // TASK_ROWS)), *order).sortWithinPartitions(*order)
    placed = kept(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)))
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    shifts = counts.select("_task", before.alias("_before"))
    return placed.join(F.broadcast(shifts), "_task").withColumn(name, F.col("_id").bitwiseAND(F.lit(_LOW)) + F.col("_before")).drop("_id", "_task", "_before")
