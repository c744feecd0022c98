"""Enrichment of alarms from the host inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("datacenter", "rack", "environment")


def enrich_alarms(alarms: DataFrame, hosts: DataFrame) -> DataFrame:
    """The inventory wins over an alarm's own tags; an unknown host keeps them, with criticality unknown and host_service its own.

    The join is left to Spark, which broadcasts the inventory only if its size allows.
    """
    own = alarms.select("*", *(F.coalesce(F.col(t), F.lit("")).alias(f"own_{t}") for t in TAGS)).drop(*TAGS)
    side = hosts.select("host", *TAGS, "criticality", F.col("service").alias("host_service"), F.lit(True).alias("known_host"))
    joined = own.join(side, "host", "left").withColumn("known_host", F.coalesce("known_host", F.lit(False)))
    joined = joined.withColumns({t: F.when(F.col("known_host"), F.col(t)).otherwise(F.col(f"own_{t}")) for t in TAGS})
    return joined.withColumns({"criticality": F.coalesce("criticality", F.lit("unknown")), "host_service": F.coalesce("host_service", "service")})


def enrichment_warnings(enriched: DataFrame) -> DataFrame:
    """(kind, n, examples): unknown hosts, alarms whose place differs from the inventory, and services that differ from their host's."""
    known = F.col("known_host")
    moved = known & ((F.col("own_datacenter") != "") & (F.col("own_datacenter") != F.col("datacenter")) | (F.col("own_rack") != "") & (F.col("own_rack") != F.col("rack")))
    conflict = F.when(known & (F.col("service") != F.col("host_service")), F.concat("host", F.lit(": "), "service", F.lit(" != "), "host_service"))

    def named(names: DataFrame, k: int) -> DataFrame:
        """How many different names, and the first k of them, which each task finds for itself before they meet."""
        few = names.orderBy("x").limit(k).agg(F.sort_array(F.collect_list("x")).alias("x"))
        return names.agg(F.count("*").alias("n")).join(F.broadcast(few))  # one row each

    hosts = named(enriched.where(~known).select(F.col("host").alias("x")).where("x IS NOT NULL").distinct(), 5)
    pairs = named(enriched.select(conflict.alias("x")).where("x IS NOT NULL").distinct(), 3)
    places = enriched.agg(F.count(F.when(moved, 1)).alias("n"), F.array().cast("array<string>").alias("x"))
    parts = [d.select(F.lit(k).alias("kind"), "n", F.col("x").alias("examples")) for k, d in (("unknown_hosts", hosts), ("moved_alarms", places), ("service_conflicts", pairs))]
    return parts[0].union(parts[1]).union(parts[2])


def cluster_gate(signal: DataFrame, min_severity: int = 4) -> DataFrame:
    return signal.where(F.col("severity") >= min_severity)
