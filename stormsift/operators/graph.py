"""The dependency graph: neighbours, hop distances, impact, centrality. Source depends on target; impact flows back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_nodes(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("service")).union(edges.select("target")).union(hosts.select("service")).distinct()


def direct_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("service")).agg(F.sort_array(F.collect_set("target")).alias("depends_on"))
    back = e.groupBy(F.col("target").alias("service")).agg(F.sort_array(F.collect_set("source")).alias("dependents"))
    none = F.array().cast("array<string>")
    return nodes.join(out, "service", "left").join(back, "service", "left").select("service", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("dependents", none).alias("dependents"))


def edge_metadata(edges: DataFrame) -> DataFrame:
    """(source, target, kind, criticality), one row a dependency; where the table says several things, the last row counts.

    The last is the highest value of a column seq if there is one (readers that see files in pieces cannot know their
    order), else of (kind, criticality), so that reruns agree.
    """
    by = F.struct("seq") if "seq" in edges.columns else F.struct("kind", "criticality")
    return edges.groupBy("source", "target").agg(F.max_by(F.struct("kind", "criticality"), by).alias("e"), F.count("*").alias("listed")).select("source", "target", "e.kind", "e.criticality", "listed")


def _reach(steps: DataFrame, max_hops: int) -> DataFrame:
    """(src, dst, hop): shortest hop along steps (src, dst), self left out. Each round extends only pairs that are new."""
    steps = steps.distinct()
    found = front = steps.where("src <> dst").select("src", "dst", F.lit(1).alias("hop"))
    for hop in range(2, max_hops + 1):
        nxt = front.select("src", F.col("dst").alias("mid")).join(steps.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src <> dst").distinct()
        front = nxt.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.union(front)
    return found


def impact_set(edges: DataFrame, max_hops: int = 3) -> DataFrame:
    return _reach(edges.select(F.col("target").alias("src"), F.col("source").alias("dst")), max_hops)


def upstream_set(edges: DataFrame, max_hops: int = 3) -> DataFrame:
    return _reach(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), max_hops)


def hop_distance(edges: DataFrame, nodes: DataFrame, max_hops: int = 3) -> DataFrame:
    both = edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).union(edges.select("target", "source"))
    return _reach(both, max_hops).union(nodes.select("service", "service", F.lit(0)))


def related_pairs(edges: DataFrame, nodes: DataFrame, max_hops: int = 2) -> DataFrame:
    """(a, b, hop, reason) for services within max_hops of each other; a reason's precedence: same, depends, reverse, hops."""
    near = hop_distance(edges, nodes, max_hops).select(F.col("src").alias("a"), F.col("dst").alias("b"), "hop")
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    near = near.join(e.withColumn("fwd", F.lit(True)), ["a", "b"], "left").join(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("rev")), ["a", "b"], "left")
    reason = (
        F.when(F.col("a") == F.col("b"), "same service")
        .when(F.col("fwd"), F.concat("a", F.lit(" depends on "), "b"))
        .when(F.col("rev"), F.concat("b", F.lit(" depends on "), "a"))
        .otherwise(F.concat(F.col("hop").cast("string"), F.lit(" hops apart")))
    )
    return near.select("a", "b", "hop", reason.alias("reason"))


def centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(service, raw, centrality): impact within 3 hops, decayed by 1, 1/2, 1/4, over the largest."""
    decay = F.when(F.col("hop") == 1, 1.0).when(F.col("hop") == 2, 0.5).otherwise(0.25)
    raw = impact_set(edges, 3).groupBy(F.col("src").alias("service")).agg(F.sum(decay).alias("raw"))
    raw = nodes.join(raw, "service", "left").select("service", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    top = raw.agg(F.greatest(F.lit(1.0), F.max("raw")).alias("top"))
    return raw.join(F.broadcast(top)).select("service", "raw", F.least(F.lit(1.0), F.col("raw") / F.col("top")).alias("centrality"))  # top: one row


def describe_service(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    near = direct_neighbours(edges, nodes).select("service", F.size("dependents").alias("n_direct"), F.slice("dependents", 1, 3).alias("first3"))
    total = impact_set(edges, 3).groupBy(F.col("src").alias("service")).agg(F.count("*").alias("n_total"))
    both = near.join(total, "service", "left").withColumn("n_total", F.coalesce("n_total", F.lit(0)))
    text = F.when(F.col("n_direct") == 0, F.concat("service", F.lit(" is a leaf: nothing depends on it"))).otherwise(F.concat(F.col("n_direct").cast("string"), F.lit(" services depend on "), "service", F.lit(" directly ("), F.concat_ws(", ", "first3"), F.lit("), "), F.col("n_total").cast("string"), F.lit(" within 3 hops")))
    return both.withColumn("text", text)


def top_central(central: DataFrame, n: int = 15) -> DataFrame:
    return central.orderBy(F.col("centrality").desc(), "service").limit(n)
