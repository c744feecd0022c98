"""Each service's own baseline and the windows in which it was above it. Times are microseconds; bins are minutes from the first alarm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.functions.asof import asof_join
from stormsift.functions.columns import half_up
from stormsift.params import DEFAULT, MINUTE, Detector, Params


def span(alarms: DataFrame) -> DataFrame:
    """One row: t0 and the number of bins, with one empty bin after the last alarm's."""
    s = alarms.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    return s.select("t0", (F.floor((F.col("t1") - F.col("t0")) / MINUTE) + 2).cast("long").alias("n_bins"))


def minute_series(alarms: DataFrame) -> DataFrame:
    """(service, bin, cnt, t0, n_bins) of bins that hold alarms; the others are zero without a row."""
    a = alarms.select("service", "us").join(F.broadcast(span(alarms)))  # span: one row
    return a.groupBy("service", F.floor((F.col("us") - F.col("t0")) / MINUTE).cast("long").alias("bin"), "t0", "n_bins").agg(F.count("*").alias("cnt"))


def service_baseline(series: DataFrame) -> DataFrame:
    """(service, baseline): the median over all bins; empty bins enter as one weighted row."""
    counts = series.groupBy("service", "cnt", "n_bins").agg(F.count("*").alias("freq"))
    empty = series.groupBy("service").agg((F.max("n_bins") - F.count("*")).alias("freq")).where("freq > 0")
    every = counts.select("service", "cnt", "freq").union(empty.select("service", F.lit(0).cast("long"), "freq"))
    return every.groupBy("service").agg(F.expr("percentile(cnt, 0.5, freq)").alias("baseline"))


def hot_bins(series: DataFrame, baseline: DataFrame, *detectors: Detector) -> DataFrame:
    """Bins whose centred rolling sum is above a detector's threshold, all detectors in one pass.

    The sum changes only where a bin's count enters or leaves it, so a bin gives four marks, however wide the window;
    a running sum over the marks holds up to the next mark. A hot bin may be empty: counts reach their neighbours.
    """
    own, none = F.col("bin"), F.lit(0).cast("long")
    limits = [F.struct(F.lit(d.kind).alias("kind"), F.lit(d.half).alias("half"), F.lit(float(d.min_count)).alias("least"), F.lit(float(d.multiplier)).alias("multiplier"), F.lit(float(d.margin)).alias("margin")) for d in detectors]
    each = series.withColumn("d", F.explode(F.array(*limits)))
    marks = [(F.greatest(own - F.col("d.half"), none), F.col("cnt"), none), (own, none, F.col("cnt")), (own + 1, none, none), (own + F.col("d.half") + 1, -F.col("cnt"), none)]
    marked = each.withColumn("m", F.explode(F.array(*(F.struct(at.alias("at"), step.alias("step"), cnt.alias("cnt")) for at, step, cnt in marks))))
    marked = marked.select("service", "t0", "n_bins", "d.*", "m.*").repartition("service", "kind")
    steps = marked.groupBy("service", "kind", "half", "least", "multiplier", "margin", "t0", "n_bins", "at").agg(F.sum("step").alias("step"), F.sum("cnt").alias("cnt"))
    w = W.partitionBy("service", "kind").orderBy("at")
    rolled = steps.withColumn("rolling", F.sum("step").over(w)).withColumn("until", F.least(F.lead("at").over(w), F.col("n_bins")))
    limit = F.greatest(F.col("least"), F.col("baseline") * F.col("multiplier") + F.col("margin"))
    hot = rolled.join(baseline, "service").withColumn("threshold", limit).where("rolling > threshold AND at < until")
    return hot.withColumn("bin", F.explode(F.sequence("at", F.col("until") - 1))).select("service", "kind", "half", "t0", "bin", "cnt", "rolling", "baseline", "threshold")


def _islands(hot: DataFrame, gap: int) -> DataFrame:
    w = W.partitionBy("service", "kind").orderBy("bin")
    new = (F.col("bin") - F.lag("bin").over(w) > gap) | F.lag("bin").over(w).isNull()
    numbered = hot.withColumn("window_no", F.sum(new.cast("int")).over(w))
    pad = F.max("half") * MINUTE
    return numbered.groupBy("service", "kind", "window_no").agg(
        (F.min(F.col("t0") + F.col("bin") * MINUTE) - pad).alias("start_us"), (F.max(F.col("t0") + (F.col("bin") + 1) * MINUTE) + pad).alias("end_us"),
        F.max("cnt").alias("peak_count"), F.first("baseline").alias("baseline_per_min"),
    )


def spike_windows(alarms: DataFrame, p: Params = DEFAULT) -> DataFrame:
    series = minute_series(alarms)
    return _islands(hot_bins(series, service_baseline(series), p.burst, p.slow), p.island_gap)


def _minutes(windows: DataFrame) -> DataFrame:
    """The windows once per clock minute that they touch."""
    return windows.withColumn("minute", F.explode(F.sequence(F.floor(F.col("start_us") / MINUTE), F.floor(F.col("end_us") / MINUTE))))


def with_in_spike(alarms: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds in_spike: a window of its service holds the alarm. Each (service, minute) has one row of time spans, so alarms are neither multiplied nor regrouped."""
    spans = _minutes(windows).groupBy("service", "minute").agg(F.collect_set(F.struct("start_us", "end_us")).alias("spans"))
    met = alarms.withColumn("minute", F.floor(F.col("us") / MINUTE)).join(spans, ["service", "minute"], "left")
    held = F.exists("spans", lambda x: F.col("us").between(x["start_us"], x["end_us"]))
    return met.select(*alarms.columns, F.coalesce(held, F.lit(False)).alias("in_spike"))


def covering(alarms: DataFrame, windows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(alarm columns, kind, window_no, start_us, end_us, further columns of windows) for every window of its service that holds the alarm, both ends included.

    Windows are dealt to the clock minutes they touch, so this is an equi-join on (service, minute).
    """
    w = _minutes(windows.select("service", "kind", "window_no", "start_us", "end_us", *also))
    return alarms.withColumn("minute", F.floor(F.col("us") / MINUTE)).join(w, ["service", "minute"]).where("us BETWEEN start_us AND end_us").drop("minute")


#: Length of a range of the time line in active_window.
RANGE = 24 * 60 * MINUTE


def active_window(alarms: DataFrame, windows: DataFrame) -> DataFrame:
    """(alarm_id, kind, window_no, in_spike): burst before slow, then the earliest.

    Windows of one service and kind follow each other in their starts and in their ends, so the earliest that can hold an
    alarm is the first that ends at or after it: an as-of join, whose rows do not grow with the length of windows.
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("kind", "window_no", "start_us"))
    ends = windows.select("service", F.col("end_us").alias("us"), "kind", "window_no", "start_us")
    near = asof_join(alarms.select("alarm_id", "service", "us"), ends, ["service"], "us", {"burst": of("burst"), "slow": of("slow")}, RANGE, forward=True)
    held = lambda c: F.when(F.col(f"{c}.start_us") <= F.col("us"), F.col(c))
    best = near.withColumn("b", F.coalesce(held("burst"), held("slow")))
    return best.select("alarm_id", F.col("b.kind").alias("kind"), F.col("b.window_no").alias("window_no"), F.col("b").isNotNull().alias("in_spike"))


def host_neighbours(alarms: DataFrame, minutes: int = 30) -> DataFrame:
    """(alarm_id, neighbours): other alarms of the host within +-minutes, both ends included."""
    w = W.partitionBy("host").orderBy("us").rangeBetween(-minutes * MINUTE, minutes * MINUTE)
    return alarms.select("alarm_id", (F.count("*").over(w) - 1).alias("neighbours"))


def _lonely_slots(alarms: DataFrame, max_severity: int, minutes: int) -> DataFrame:
    """(host, slot, alarm_id) of lonely alarms. Two alarms of one host in one slot are neighbours, so only slots
    of one alarm are compared, with the alarms nearest in the slots beside: a hot host costs counts, not a sort."""
    size = minutes * MINUTE
    a = alarms.withColumn("slot", F.floor(F.col("us") / size))
    slots = a.groupBy("host", "slot").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.min(F.struct("alarm_id", "us", "severity")).alias("one"))
    before = slots.select("host", (F.col("slot") + 1).alias("slot"), F.col("hi").alias("last"))
    after = slots.select("host", (F.col("slot") - 1).alias("slot"), F.col("lo").alias("next"))
    single = slots.where(F.col("n") == 1).where(F.col("one.severity") <= max_severity)
    met = single.join(before, ["host", "slot"], "left").join(after, ["host", "slot"], "left")
    alone = (F.col("last").isNull() | (F.col("one.us") - F.col("last") > size)) & (F.col("next").isNull() | (F.col("next") - F.col("one.us") > size))
    return met.where(alone).select("host", "slot", "one.alarm_id")


def lonely(alarms: DataFrame, max_severity: int, minutes: int = 30) -> DataFrame:
    """alarm_id of rows of low severity without neighbours."""
    return _lonely_slots(alarms, max_severity, minutes).select("alarm_id")


def with_is_lonely(alarms: DataFrame, max_severity: int, minutes: int = 30) -> DataFrame:
    """Adds is_lonely. A lonely alarm is the only one in its slot, so host and slot find it."""
    slots = _lonely_slots(alarms, max_severity, minutes).select(F.col("host").alias("at_host"), F.col("slot").alias("at_slot"), F.lit(True).alias("is_lonely"))
    found = alarms.join(slots, F.col("host").eqNullSafe(F.col("at_host")) & (F.floor(F.col("us") / (minutes * MINUTE)) == F.col("at_slot")), "left")
    return found.select(*alarms.columns, F.coalesce("is_lonely", F.lit(False)).alias("is_lonely"))


def window_report(windows: DataFrame) -> DataFrame:
    return windows.select("service", "kind", "start_us", "end_us", "peak_count", "baseline_per_min", half_up((F.col("end_us") - F.col("start_us")) / float(MINUTE), 1).alias("duration_min"))


def baseline_summary(baseline: DataFrame, windows: DataFrame) -> DataFrame:
    w = windows.agg(F.count(F.when(F.col("kind") == "burst", 1)).alias("burst_windows"), F.count(F.when(F.col("kind") == "slow", 1)).alias("slow_windows"))
    b = baseline.agg(F.count("*").alias("services"), half_up(F.coalesce(F.avg("baseline"), F.lit(0.0)), 2).alias("mean_baseline"))
    return b.join(F.broadcast(w))  # one row each


def type_time_spread(alarms: DataFrame) -> DataFrame:
    a = alarms.join(F.broadcast(alarms.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))))  # one row
    m = (F.col("us") - F.col("t0")) / float(MINUTE)
    return a.groupBy("alarm_type").agg(F.count("*").alias("n"), half_up(F.stddev_pop(m), 3).alias("std_min"), half_up(F.max((F.col("t1") - F.col("t0")) / float(MINUTE)) / 12**0.5, 3).alias("uniform_std"))
