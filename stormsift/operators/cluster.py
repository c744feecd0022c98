"""Temporal clusters: spike windows claim the severe alarms that they hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.functions.ordering import in_order
from stormsift.operators.baseline import covering, spike_windows
from stormsift.params import DEFAULT, Params
from stormsift.sources.io import kept


def _with_island(windows: DataFrame) -> DataFrame:
    """Numbers runs of overlapping windows of a service; only windows of one run compete for alarms."""
    w = W.partitionBy("service").orderBy("start_us", "window_no")
    reach = F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    return windows.withColumn("island", F.sum((reach.isNull() | (F.col("start_us") > reach)).cast("int")).over(w))


def claim(alarms: DataFrame, windows: DataFrame, min_alarms: int, min_severity: int = 0) -> DataFrame:
    """(alarm_id, service, window_no): windows in order of time take the alarms not yet taken; too few or too mild, and the window takes none.

    Alarms that lie in the same windows fare alike, so the claim runs on their counts: a task holds the distinct sets of
    windows in one run of overlapping ones, however many alarms a service raises.
    """
    def take(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [[(w["start_us"], w["window_no"]) for w in ws] for ws in rows["windows"]]
        owner: list[int | None] = [None] * len(rows)
        for w in sorted({w for ws in sets for w in ws}):
            free = [k for k, ws in enumerate(sets) if owner[k] is None and w in ws]
            if sum(rows["n"].iloc[free]) >= min_alarms and max(rows["severity"].iloc[free], default=-1) >= min_severity:
                for k in free:
                    owner[k] = w[1]
        return rows.assign(window_no=pd.array(owner, "Int64"))[["service", "island", "place", "window_no"]].dropna()

    islands = _with_island(windows)
    pairs = covering(alarms.select("alarm_id", "service", "us", "severity"), islands, ("island",))
    per_alarm = pairs.groupBy("alarm_id", "service", "island").agg(F.sort_array(F.collect_list(F.struct("start_us", "window_no"))).alias("windows"), F.max("severity").alias("severity"))
    per_alarm = per_alarm.withColumn("place", F.to_json("windows"))
    alike = per_alarm.groupBy("service", "island", "place").agg(F.first("windows").alias("windows"), F.count("*").alias("n"), F.max("severity").alias("severity"))
    claimed = alike.groupBy("service", "island").applyInPandas(take, "service string, island long, place string, window_no long")
    return per_alarm.join(claimed, ["service", "island", "place"]).select("alarm_id", "service", "window_no")


def find_clusters(signal: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(alarm_id, cluster_id, window_kind) from a baseline model of the severe signal itself: bursts first, then slow windows over the rest."""
    windows = kept(spike_windows(signal, p))
    burst = kept(claim(signal, windows.where("kind = 'burst'"), p.burst_min_alarms).withColumn("window_kind", F.lit("burst")))
    rest = signal.join(burst.select("alarm_id"), "alarm_id", "left_anti")
    slow = claim(rest, windows.where("kind = 'slow'"), p.slow_min_alarms, p.slow_min_severity).withColumn("window_kind", F.lit("slow_burn"))
    members = kept(burst.union(slow))
    found = in_order(members.select("window_kind", "service", "window_no").distinct(), ["window_kind", "service", "window_no"], "number", cheap=True)
    ids = found.select("window_kind", "service", "window_no", F.format_string("CL-%03d", F.col("number") + 1).alias("cluster_id"))
    return members.join(ids, ["window_kind", "service", "window_no"]).select("alarm_id", "cluster_id", "window_kind")


def cluster_summary(members: DataFrame, alarms: DataFrame) -> DataFrame:
    a = members.join(alarms, "alarm_id").withColumn("location", F.concat_ws("/", "datacenter", "rack"))
    return a.groupBy("cluster_id", "service", "window_kind").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.sort_array(F.collect_set("host")).alias("hosts"), F.sort_array(F.collect_set("location")).alias("locations"), F.max("severity").alias("max_severity"))
