"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormsift.params import CRITICALITY_WEIGHT, OWNERS, PATTERNS, SEVERITY_LABEL, TYPE_PRIOR


def with_alarms(members: DataFrame, alarms: DataFrame, *columns: str) -> DataFrame:
    """members (alarm_id, ...) with these columns of their alarms; what members carry already is not joined again."""
    missing = [c for c in columns if c not in members.columns]
    return members.join(alarms.select("alarm_id", *missing), "alarm_id") if missing else members


def lookup(key: Column, values: Mapping, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key], default)


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in every engine."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def type_prior(alarm_type: Column, default: float = 0.35) -> Column:
    return lookup(alarm_type, TYPE_PRIOR, F.lit(default))


def owner(alarm_type: Column) -> Column:
    return lookup(alarm_type, {t: who for who, types in OWNERS.items() for t in types}, F.lit("platform-oncall"))


def family(root_type: Column) -> Column:
    """The pattern that holds the type as a root, else the type itself."""
    return lookup(root_type, {t: key for key, roots, _ in reversed(PATTERNS) for t in roots}, root_type)


def criticality_weight(criticality: Column) -> Column:
    return lookup(criticality, CRITICALITY_WEIGHT, F.lit(0.5))


def with_location(df: DataFrame) -> DataFrame:
    return df.withColumn("location", F.concat_ws("/", "datacenter", "rack"))


def with_severity_label(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_label", lookup(F.col("severity"), SEVERITY_LABEL, F.col("severity").cast("string")))


def with_type_prior(df: DataFrame, default: float = 0.35) -> DataFrame:
    return df.withColumn("type_prior", type_prior(F.col("alarm_type"), default))
