"""As-of join: each row of the left side meets the nearest row of the right side before (or after) it in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, values: dict[str, Column], width: int, forward: bool = False) -> DataFrame:
    """left with, for each of values, the last of it that is not null among right's rows of its keys at or before its time.

    Both sides have the columns on and time (a long); values are expressions over right. forward takes the first at or
    after instead. Rows of left are kept one for one, also those with null keys or time, which meet nothing.

    Both sides are laid on one time line, which is cut into ranges of width: a task sorts the rows of one key and range,
    so a key that holds most rows is many tasks. What a range has not seen of its own comes from the ranges before it,
    which are one row for each key and range that holds anything.
    """
    sign = -1 if forward else 1
    names = list(values)
    at = (F.col(time) * sign).alias("_t")
    own = F.struct(*left.columns).alias("_l")
    l_rows = left.select(*on, at, F.lit(1).alias("_side"), own, *(F.lit(None).alias(n) for n in names))
    r_rows = right.select(*on, at, F.lit(0).alias("_side"), *(v.alias(n) for n, v in values.items()))
    line = r_rows.unionByName(l_rows, allowMissingColumns=True).withColumn("_range", F.floor(F.col("_t") / width))
    w = W.partitionBy(*on, "_range").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    near = line.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names}).where("_side = 1")
    ends = line.groupBy(*on, "_range").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_t"))).alias(f"_{n}") for n in names))
    past = W.partitionBy(*on).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # ranges of a key, no rows
    before = ends.select(*on, "_range", *(F.last(f"_{n}", ignorenulls=True).over(past).alias(f"_{n}") for n in names))
    met = near.join(before, [*on, "_range"], "left")  # null keys meet nothing here
    whole = F.lit(True)
    for c in (*on, "_t"):
        whole = whole & F.col(c).isNotNull()
    return met.select("_l.*", *(F.when(whole, F.coalesce(n, f"_{n}")).alias(n) for n in names))
