"""Reports over the result: timeline, integrity, summary, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormsift.functions.columns import half_up
from stormsift.params import MINUTE


def timeline(alarms: DataFrame, owners: DataFrame) -> DataFrame:
    """(minute_us, owner, n) per clock minute; owners are (alarm_id, owner), others count as NOISE."""
    a = alarms.select("alarm_id", (F.floor(F.col("us") / MINUTE) * MINUTE).alias("minute_us")).join(owners, "alarm_id", "left")
    return a.groupBy("minute_us", F.coalesce("owner", F.lit("NOISE")).alias("owner")).agg(F.count("*").alias("n"))


def timeline_filled(line: DataFrame, most_owners: int = 1000) -> DataFrame:
    """Every minute that occurs for every owner, zeros filled. Owners are cards, so at most the cap and two; beyond most_owners
    they are refused, as the result is their product with the minutes."""
    minutes, owners = line.select("minute_us").distinct(), line.select("owner").distinct()
    few = [r["owner"] for r in owners.limit(most_owners + 1).collect()]  # bounded, and checked
    if len(few) > most_owners:
        raise ValueError(f"more than {most_owners} owners")
    every = minutes.withColumn("owner", F.explode(F.lit(few) if few else F.array().cast("array<string>")))
    return every.join(line, ["minute_us", "owner"], "left").select("minute_us", "owner", F.coalesce("n", F.lit(0)).alias("n"))


def integrity(alarms: DataFrame, held: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: what cards (their membership) and ledger hold together, and whether nothing was lost or doubled."""
    both = held.select("alarm_id", F.lit("card").alias("at")).union(entries.select("alarm_id", F.lit("ledger").alias("at")))
    h = both.agg(F.count(F.when(F.col("at") == "card", 1)).alias("in_cards"), F.count(F.when(F.col("at") == "ledger", 1)).alias("in_ledger"), F.countDistinct("alarm_id").alias("distinct_ids"))
    n = alarms.agg(F.count("*").alias("expected"))
    one = h.join(F.broadcast(n))  # one row each
    return one.withColumn("no_loss", F.col("in_cards") + F.col("in_ledger") == F.col("expected")).withColumn("ids_unique", F.col("distinct_ids") == F.col("expected"))


def summary(alarms: DataFrame, classified: DataFrame, clusters: DataFrame, incidents: DataFrame, capped: DataFrame, held: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the funnel from raw alarms to cards, the factor of the reduction, and the key figures.

    clusters have n alarms each; signal are the alarms that the rules leave, clustered those in clusters (also of
    incidents that fail the gate), linked those of cards of their own, unclassified those of the bucket.
    """
    bucket = F.col("card_id") == "INC-UNCLUSTERED"
    parts = [
        alarms.agg(F.count("*").alias("raw")),
        classified.agg(F.count(F.when(F.col("rule").isNull(), 1)).alias("signal")),
        clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered")),
        incidents.agg(F.count("*").alias("incidents"), F.count(F.when(F.col("passes"), 1)).alias("passing")),
        capped.agg(F.count(F.when(F.col("slot") == "card", 1)).alias("own_cards"), F.count(F.when(F.col("slot") == "bucket", 1)).alias("rolled_up"), F.countDistinct("card_id").alias("cards")),
        held.agg(F.count(F.when(~bucket, 1)).alias("linked"), F.count(F.when(bucket, 1)).alias("unclassified")),
        entries.agg(F.count("*").alias("noise")),
    ]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    share = lambda c: half_up(F.col(c) / F.greatest(F.lit(1), F.col("raw")) * 100.0, 1)
    return one.withColumns({"reduction": half_up(F.col("raw") / F.greatest(F.lit(1), F.col("cards")), 1), "noise_percent": share("noise"), "unclassified_percent": share("unclassified")})


def funnel(row: DataFrame) -> DataFrame:
    """(step, stage, n) from the summary: raw alarms, signal, clusters, incidents, cards of their own."""
    stages = ("raw", "signal", "clusters", "incidents", "own_cards")
    return row.select(F.inline(F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(c).alias("stage"), F.col(c).cast("long").alias("n")) for k, c in enumerate(stages)))))


def incident_log(members: DataFrame, alarms: DataFrame, incident_id: str, n: int = 600) -> DataFrame:
    return members.where(F.col("incident_id") == incident_id).join(alarms, "alarm_id").orderBy("us", "alarm_id").limit(n)
