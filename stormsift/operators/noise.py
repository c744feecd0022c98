"""Noise rules and the ledger in which every dropped alarm is kept with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormsift.operators.baseline import with_in_spike, with_is_lonely
from stormsift.params import DEFAULT, MAINTENANCE_TYPES, Params

Rule = tuple[str, Column, Column]


def default_rules(p: Params = DEFAULT) -> list[Rule]:
    """(name, condition, reason) in order; the first that holds wins. Conditions may use in_spike and is_lonely."""
    return [
        ("maintenance_chatter", F.col("alarm_type").isin(*MAINTENANCE_TYPES), F.concat(F.lit("maintenance type "), "alarm_type")),
        ("isolated_low_severity", (F.col("severity") <= p.lonely_severity) & F.col("is_lonely"), F.concat(F.lit("severity "), F.col("severity").cast("string"), F.lit(f" and no other alarm on "), "host", F.lit(f" within {p.lonely_minutes} min"))),
        ("background_baseline", (F.col("severity") <= p.background_severity) & ~F.col("in_spike"), F.concat(F.lit("severity "), F.col("severity").cast("string"), F.lit(" outside every spike window of "), "service")),
    ]


def classify_noise(alarms: DataFrame, windows: DataFrame, rules: Sequence[Rule] | None = None, p: Params = DEFAULT) -> DataFrame:
    """All alarms with rule and reason; both null for signal."""
    rules = default_rules(p) if rules is None else rules
    a = with_is_lonely(with_in_spike(alarms, windows), p.lonely_severity, p.lonely_minutes)
    rule, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, condition, text in reversed(rules):
        rule, reason = F.when(condition, name).otherwise(rule), F.when(condition, text).otherwise(reason)
    return a.withColumns({"rule": rule, "reason": reason})


def ledger(classified: DataFrame, clustered: DataFrame, carded: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(alarm columns, rule, reason) of all alarms in no card: rules, then low severity in a window, no cluster, weak incident.

    clustered and carded are (alarm_id) of cluster members and of members of incidents that pass the gate.
    """
    a = classified.join(clustered.select("alarm_id", F.lit(True).alias("in_cluster")), "alarm_id", "left").join(carded.select("alarm_id", F.lit(True).alias("in_card")), "alarm_id", "left")
    late = F.when(F.col("severity") < p.cluster_severity, "background_in_window").when(F.col("in_cluster").isNull(), "unclustered_residual").when(F.col("in_card").isNull(), "low_confidence_cluster")
    texts = {"background_in_window": "below the severity that joins clusters", "unclustered_residual": "in no dense enough cluster", "low_confidence_cluster": "its incident failed the quality gate"}
    a = a.withColumn("rule", F.coalesce("rule", late)).where("rule IS NOT NULL")
    reason = F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[F.col("rule")]
    return a.withColumn("reason", F.coalesce("reason", reason)).drop("in_cluster", "in_card")


def rule_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rule")


def ledger_cube(entries: DataFrame) -> DataFrame:
    """(level, rule, service, severity, n, first_us, last_us): the ledger's counts by rule, service and severity at once.

    One pass: grouping sets expand a row into the five combinations, which are added up before they are shuffled. level is
    Spark's grouping id (a bit for each column that is summed over), so a null name is told from a total.
    """
    sets = [("rule", "service", "severity"), ("rule", "service"), ("rule", "severity"), ("rule",), ()]
    columns = ["rule", "service", "severity"]
    g = entries.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return g.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def audit_search(entries: DataFrame, rules: Sequence[str] = (), severities: Sequence[int] = (), text: str = "", services: Sequence[str] = ()) -> DataFrame:
    """Ledger rows by rule, severity, service, and a case-insensitive regular expression in id, message or type."""
    out = entries
    if rules:
        out = out.where(F.col("rule").isin(*rules))
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if services:
        out = out.where(F.col("service").isin(*services))
    if text:
        pattern = f"(?i){text}"
        out = out.where(F.col("alarm_id").rlike(pattern) | F.col("message").rlike(pattern) | F.col("alarm_type").rlike(pattern))
    return out
