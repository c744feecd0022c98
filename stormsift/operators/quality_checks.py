"""Input checks: each gives one row (check, passed, expected, actual)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, expected: Column, actual: Column, passed: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("check"), (expected == actual if passed is None else passed).alias("passed"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def check_count(df: DataFrame, name: str, expected: int) -> DataFrame:
    return _row(df.agg(F.count("*").alias("n")), name, F.lit(expected), F.col("n"))


def check_service_catalogue(hosts: DataFrame, edges: DataFrame, expected: int) -> DataFrame:
    services = hosts.select("service").union(edges.select("source")).union(edges.select("target")).distinct()
    return _row(services.agg(F.count("*").alias("n")), "services", F.lit(expected), F.col("n"))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    return _row(df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")), f"unique_{key}", F.col("n"), F.col("d"))


def check_orphans(alarms: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    lost = alarms.select(key).distinct().join(dimension.select(key).distinct(), key, "left_anti")
    return _row(lost.agg(F.count("*").alias("n")), f"orphan_{key}", F.lit(0), F.col("n"))


def check_severity_domain(alarms: DataFrame) -> DataFrame:
    return _row(alarms.agg(F.count(F.when(~F.col("severity").between(1, 5) | F.col("severity").isNull(), 1)).alias("n")), "severity_domain", F.lit(0), F.col("n"))


def check_observation_window(alarms: DataFrame, start_us: int, end_us: int, grace_minutes: int = 5) -> DataFrame:
    grace = grace_minutes * 60_000_000
    outside = (F.col("us") < start_us - grace) | (F.col("us") > end_us + grace)
    return _row(alarms.agg(F.count(F.when(outside, 1)).alias("n")), "observation_window", F.lit(0), F.col("n"))


def check_same_ids(left: DataFrame, right: DataFrame, key: str = "alarm_id") -> DataFrame:
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return _row(a.subtract(b).union(b.subtract(a)).agg(F.count("*").alias("n")), "same_ids", F.lit(0), F.col("n"))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, checks)
