"""Approximate summaries that merge: kept once for each service and day, they answer for any span of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.params import MINUTE

DAY = 24 * 60 * MINUTE
#: Sizes: 2^12 buckets of HLL (1.6 % standard error), 2^12 entries of theta (exact below, then 1.6 %), 200 items of KLL
#: (ranks off by at most about 1.33 %).
LOG_BUCKETS, LOG_ENTRIES, ITEMS = 12, 12, 200
#: Ranks of a merged quantile sketch may be off by so much (twice the error of one query at that size).
RANK_ERROR = 0.0266


def daily_sketches(alarms: DataFrame) -> DataFrame:
    """(service, day, n, hosts, host_set, busy): alarms, HLL and theta sketches of hosts, KLL of alarms in busy minutes.

    A sketch has a bounded size whatever it holds, and partial sketches merge before the shuffle. This is the table to keep:
    merged_sketches and shared_hosts need no alarms.
    """
    day = F.floor(F.col("us") / DAY).alias("day")
    hosts = alarms.groupBy("service", day).agg(F.count("*").alias("n"), F.hll_sketch_agg("host", LOG_BUCKETS).alias("hosts"), F.theta_sketch_agg("host", LOG_ENTRIES).alias("host_set"))
    minutes = alarms.groupBy("service", day, F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.count("*").alias("cnt"))
    busy = minutes.groupBy("service", "day").agg(F.kll_sketch_agg_bigint("cnt", ITEMS).alias("busy"))
    return hosts.join(busy, ["service", "day"])


def merged_sketches(daily: DataFrame, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """(service, days, n, hosts, host_set, busy) over the days from first_day to last_day."""
    d = daily if first_day is None else daily.where(F.col("day") >= first_day)
    d = d if last_day is None else d.where(F.col("day") <= last_day)
    return d.groupBy("service").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.hll_union_agg("hosts").alias("hosts"), F.theta_union_agg("host_set", LOG_ENTRIES).alias("host_set"), F.kll_merge_agg_bigint("busy").alias("busy"))


def sketch_report(merged: DataFrame) -> DataFrame:
    """(service, days, n, hosts, busy_minutes, median_busy): estimates from merged sketches."""
    return merged.select("service", "days", "n", F.hll_sketch_estimate("hosts").alias("hosts"), F.kll_sketch_get_n_bigint("busy").alias("busy_minutes"), F.kll_sketch_get_quantile_bigint("busy", F.lit(0.5)).alias("median_busy"))


def shared_hosts(daily: DataFrame) -> DataFrame:
    """(service, day, next_day, shared): hosts that alarm on a day and on the service's next day with alarms."""
    w = W.partitionBy("service").orderBy("day")  # days of a service
    both = daily.withColumn("next_day", F.lead("day").over(w)).withColumn("after", F.lead("host_set").over(w)).where("next_day IS NOT NULL")
    return both.select("service", "day", "next_day", F.theta_sketch_estimate(F.theta_intersection("host_set", "after")).alias("shared"))
