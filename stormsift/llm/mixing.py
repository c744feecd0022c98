"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import HOT_KEYS, WORD_PATTERN, skew_join, table, written

#: Words in a block, documents in a shard about, shards in a rack (a source has as many racks as its documents need).
BLOCK, SHARD_DOCS, RACK = 8, 100, 4096
#: No document is taken more than CAP times; the weights of the sources repeat by rank (fixed values of the contract).
CAP, WEIGHTS = 3, (5, 2, 1)
#: Divisors that one pass tries at once.
PROBES = 64


def with_rank(sources: DataFrame, key: str) -> DataFrame:
    """Adds rank (from 0) by key, null last, without one task for all: ranges are counted, then rows number themselves within."""
    ranged = written(sources.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row per range
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total)]
        total += n
    if not before:
        return ranged.withColumn("rank", F.lit(0).cast("long")).drop("part")
    row = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return ranged.withColumn("rank", (row - 1 + F.create_map(*before)[F.col("part")]).cast("long")).drop("part")


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source_size, weight, ...): shares by weight, none above CAP times its size; the excess is dealt again until all fit.

    Each pass is one sum over sources that are still free; only two numbers reach the driver. A pass fixes a source for
    good, so there are no more passes than distinct ratios of size to weight, and few in practice.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # free: those whose share at the present level stays below the cap
        x = sources.agg(
            F.sum(F.when(F.col("weight") * F.lit(level) >= CAP * F.col("source_size"), CAP * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(F.col("weight") * F.lit(level) >= CAP * F.col("source_size"), 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not x["free"]:
            break
        new = (total - x["fixed"]) / x["free"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), CAP * F.col("source_size").cast("double")))


def sainte_lague(parties: DataFrame, votes: str, seats: int, order: list[str]) -> DataFrame:
    """Adds seats: the `seats` highest quotients votes / (2k - 1) win, ties by order.

    Quotients above a divisor d number floor(votes / d / 2 + 1/2) per party, so the winners follow from the divisor at
    which the sum meets the seats. Each pass sums PROBES divisors at once; ties at the last quotient are a top-k.
    """
    total = parties.agg(F.sum(votes)).first()[0] or 0
    won = lambda d: F.floor(F.col(votes) * F.lit(d) + 0.5)
    if not seats or not total:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low, high = 0.0, 2.0 * seats / total
    while high and (parties.agg(F.sum(won(high))).first()[0]) < seats:
        low, high = high, 2 * high
    for _ in range(8):
        tries = [low + (high - low) * k / PROBES for k in range(1, PROBES)]
        sums = parties.agg(*(F.sum(won(d)).alias(f"s{k}") for k, d in enumerate(tries))).first()
        under = [d for d, n in zip(tries, sums, strict=True) if n <= seats]
        over = [d for d, n in zip(tries, sums, strict=True) if n > seats]
        low, high = max([low, *under]), min([high, *over])
    sure = parties.withColumn("seats", won(low).cast("long")).withColumn("more", (won(high) - won(low)).cast("long"))
    left = seats - (sure.agg(F.sum("seats")).first()[0] or 0)
    tied = sure.where("more > 0").orderBy((F.col(votes) / (2 * F.col("seats") + 1)).desc(), *order).limit(max(0, left))
    return sure.drop("more").join(tied.select(*order, F.lit(1).alias("extra")), order, "left").withColumn("seats", F.col("seats") + F.coalesce("extra", F.lit(0))).drop("extra")


def highest_quotients(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each party: the `seats` highest quotients votes / (2k - 1) win, ties to the party that comes first."""
    total = votes.sum()
    if seats <= 0 or not total:
        return np.zeros(len(votes), np.int64)
    won = lambda d: np.floor(votes * d + 0.5).astype(np.int64)
    low, high = 0.0, 2.0 * seats / total
    while won(high).sum() < seats:
        high *= 2
    for _ in range(80):
        d = (low + high) / 2
        low, high = (d, high) if won(d).sum() <= seats else (low, d)
    out = won(low)
    for k in np.lexsort((np.arange(len(votes)), -votes / (2 * out + 1)))[: seats - int(out.sum())]:
        out[k] += 1
    return out


def seats_within(parties: DataFrame, by: list[str], key: str, seats: str) -> DataFrame:
    """Adds won (long) to (by..., key, votes, seats): the seats of each group dealt among its parties. A group is one task's: racks of a source, or shards of a rack."""
    def deal(part: pa.Table) -> pa.Table:
        part = part.sort_by(key)
        won = highest_quotients(part.column("votes").to_numpy().astype(np.float64), part.column(seats)[0].as_py())
        return part.append_column("won", pa.array(won))

    kinds = ", ".join(f"{c} {t}" for c, t in parties.dtypes)
    return parties.groupBy(*by).applyInArrow(deal, f"{kinds}, won long")


def in_parcels(rows: DataFrame, hot: DataFrame | None, carry: bool) -> DataFrame:
    """Adds parcel, mark and n (equal rows that one row stands for): rows of keys that are not hot stand for themselves.

    Equal rows of a hot key are counted where they lie, so no task gathers them, and their number is cut into parcels of
    SHARD_DOCS, each of which goes to a shard of its own. With carry, equal means equal in all columns of doc (mark is their
    hash), and any of the equal docs stands for all.
    """
    own = {"parcel": F.lit(0).cast("long"), "mark": F.lit(0).cast("long"), "n": F.lit(1).cast("long")}
    if hot is None:
        return rows.drop("key").withColumns(own)
    plain = rows.join(F.broadcast(hot), "key", "left_anti").drop("key").withColumns(own)
    many = rows.join(F.broadcast(hot), "key", "left_semi").withColumn("mark", F.xxhash64(F.to_json("doc")) if carry else F.lit(0).cast("long"))
    many = many.groupBy("doc_id", "source", "size", "tie", "mark").agg(F.count("*").alias("all"), *((F.any_value("doc").alias("doc"),) if carry else ()))
    many = many.withColumn("parcel", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / SHARD_DOCS))))
    many = many.withColumn("n", F.least(F.lit(SHARD_DOCS).cast("long"), F.col("all") - F.col("parcel") * SHARD_DOCS)).drop("all")
    return plain.unionByName(many)


def mix_sources(docs: DataFrame, seed: int = 42, block: int = BLOCK, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and where its taken words lie.

    Sizes are words; sources by code point (null last) weigh 5, 2, 1 in turn. Blocks of equal words are apportioned to
    sources, then to each source's racks and each rack's shards. In a shard the documents stand in seeded order as one ring of words; its
    quota of blocks is taken as whole rounds, and the rest as blocks from a seeded start, so only the two documents at
    the ends of that run are cut. Columns: `rounds` whole copies and words [part_from, part_to) once more, which wrap
    around if part_from > part_to; with carry also `doc`, the row as a struct.

    Null and empty texts have size 0 and nothing taken; an empty table gives no rows; repeated rows are documents of
    their own; other columns are read with carry alone. Reruns agree: order and start come from hashes of seed, text and
    doc_id. Equal rows (same doc_id, source and text) of more than a shard's number, and of more than one in HOT_KEYS of
    all rows, are dealt to shards in parcels; with carry rows are equal that agree in all columns, so parcels, and with
    them the words taken of such rows, may differ from those without.
    """
    row = (F.struct("*").alias("doc"),) if carry else ()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "text", "doc_id").alias("tie"), *row)
    rows = rows.withColumn("key", F.xxhash64("source", "doc_id", "tie"))
    sized = written(rows.drop("doc"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("copies"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = written(with_targets(with_rank(sources, "source").withColumn("weight", weight)))
    x = sources.agg(F.sum("source_size").alias("words"), F.sum("copies").alias("docs")).first()
    hot = written(sized.groupBy("key").count().where(F.col("count") > max(SHARD_DOCS, (x["docs"] or 0) // HOT_KEYS)).select("key"))  # fewer than HOT_KEYS longs
    hot = hot if hot.head(1) else None
    sources = sainte_lague(sources, "target", round((x["words"] or 0) / block), ["rank"])
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("copies") / SHARD_DOCS)).cast("long")
    sources = written(sources.withColumn("n_shards", n_shards).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).select("source_key", "rank", "source_size", "target", "seats", "n_shards", "copies"))

    at = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), F.col("n_shards"))
    parcel_at = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie", "mark", "parcel"), F.col("n_shards"))

    def in_shards(df: DataFrame) -> DataFrame:
        df = df.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
        return skew_join(df, sources, ["source_key"], x["docs"] or 0, "inner").withColumn("shard", F.when(F.col("parcel") + F.col("mark") == 0, at).otherwise(parcel_at))

    shards = in_shards(in_parcels(rows if carry and hot is not None else sized, hot, carry).drop("doc")).groupBy("rank", "shard")
    shards = shards.agg(F.sum(F.col("size") * F.col("n")).alias("votes"), F.max("seats").alias("seats"), F.sum("n").alias("copies"))
    shards = written(shards.withColumn("rack", F.floor(F.col("shard") / RACK)))
    racks = shards.groupBy("rank", "rack").agg(F.sum("votes").alias("votes"), F.max("seats").alias("seats"))
    racks = seats_within(racks, ["rank"], "rack", "seats").select("rank", "rack", F.col("won").alias("quota"))
    shards = seats_within(shards.join(racks, ["rank", "rack"]), ["rank", "rack"], "shard", "quota")
    shards = written(shards.select("rank", "shard", F.col("votes").alias("shard_size"), F.col("won").alias("blocks"), "copies"))
    cell = W.partitionBy("rank", "shard")
    rows = in_shards(in_parcels(rows if carry else sized, hot, carry)).drop("source_key", "seats", "n_shards")
    order = cell.orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "tie", "mark", "parcel")
    rows = rows.withColumn("end", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # a shard holds about SHARD_DOCS rows, or one in HOT_KEYS of all rows if these are equal: no key of this join is hot
    rows = rows.join(shards.drop("copies"), ["rank", "shard"])
    if hot is not None:
        rows = rows.withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("end", F.col("end") - F.col("left") * F.col("size"))
    return placed(rows, block, seed, ("doc",) if carry else ())


def placed(rows: DataFrame, block: int, seed: int, more: tuple[str, ...] = ()) -> DataFrame:
    size, ring = F.col("size"), F.col("shard_size")
    quota = F.least(F.col("blocks") * block, CAP * ring)
    rounds = F.when(ring > 0, F.floor(quota / ring)).otherwise(0).cast("long")
    rows = rows.withColumn("rounds", rounds).withColumn("rest", quota - F.col("rounds") * ring)
    starts = F.floor((ring + block - 1) / block)
    at = F.when(ring > 0, F.pmod(F.xxhash64(F.lit(seed + 3), "rank", "shard"), F.greatest(starts, F.lit(1))) * block).otherwise(0)
    rows = rows.withColumn("at", at.cast("long")).withColumn("begin", F.col("end") - size)
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    stop = F.col("at") + F.col("rest")
    first, wrapped = over(F.col("at"), F.least(stop, ring)), over(F.lit(0), stop - ring)
    rows = rows.withColumn("first", first).withColumn("wrapped", wrapped)
    part_from = F.when(F.col("first") > 0, F.greatest(F.col("at") - F.col("begin"), F.lit(0))).otherwise(0)
    part_to = F.when(F.col("wrapped") > 0, F.col("wrapped")).when(F.col("first") > 0, part_from + F.col("first")).otherwise(0)
    both = (F.col("wrapped") > 0) & (F.col("first") > 0)
    part_from = F.when(both, part_from).when(F.col("wrapped") > 0, 0).otherwise(part_from)
    part = F.col("first") + F.col("wrapped")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("rounds") * size + part).cast("long").alias("taken"), F.when(size > 0, F.col("rounds")).otherwise(0).alias("rounds"), part_from.cast("long").alias("part_from"), part_to.cast("long").alias("part_to"), part.cast("long").alias("part"), "tie", *more)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
