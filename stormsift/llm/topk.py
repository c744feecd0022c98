"""Exact top-k search by inner product: bounds from segment means and deviations, coarse to fine, then exact scores of survivors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import table, written

#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)
#: Components in a block of queries and of candidates (32,768 and 4,096 vectors of 64), and queries that a task holds
#: against a block at once.
QUERY_SIZE, BLOCK_SIZE, AT_ONCE = 1 << 21, 1 << 18, 512
#: Candidate blocks that a task holds against its block of queries: as many as leave TASKS tasks, and RUN at most.
RUN, TASKS = 16, 1024


def stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment, sqrt(length) * mean, then the norm of what deviates from it; the product of two rows bounds their inner product from above."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    means, norms = [], []
    for p in parts:
        part = x[:, p]
        mean = part.mean(1) if len(p) else np.zeros(len(x))
        means.append(np.sqrt(len(p)) * mean)
        norms.append(np.sqrt(((part - mean[:, None]) ** 2).sum(1)))
    return np.stack(means + norms, 1)


@dataclass
class Block:
    """Vectors with their ids and their statistics on each level, which are made anew from the vectors: what is sent is less by more than half."""

    ids: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["data"], np.int32 if row["narrow"] else np.int64).reshape(len(ids), -1).astype(np.float64)
        return Block(ids, x, [stats(x, s) for s in LEVELS])


def block_top(q: Block, blocks: list[Block], k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query place, id, score) of each query's k best among all blocks that reach its least, ties to smaller ids; a query
    never meets its own id. least rises to each query's k-th best score.

    Scores are integers, so a bound that lies half a unit below the k-th score found so far rules a candidate out.
    """
    top = max([0.0, *(np.abs(b.x).max(initial=0) for b in (q, *blocks))])
    kind = np.int64 if top**2 * q.x.shape[1] >= 2**52 else np.float64
    exact = q.x.astype(kind)
    rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for c in blocks:
        for at in range(0, len(q.ids), AT_ONCE):
            here = slice(at, at + AT_ONCE)
            alive, columns = None, np.arange(len(c.ids))
            for mine, theirs in zip(q.levels, c.levels, strict=True):
                bound = mine[here] @ theirs[columns].T
                keep = bound + 1e-6 * np.abs(bound) + 0.5 >= least[here, None]
                alive = keep if alive is None else alive & keep
                some = alive.any(0)
                alive, columns = alive[:, some], columns[some]
            if not len(columns):
                continue
            s = exact[here] @ c.x[columns].astype(kind).T
            alive &= (s >= least[here, None]) & (q.ids[here, None] != c.ids[columns][None, :])
            score = np.where(alive, s, -np.inf)
            if len(columns) > k:
                alive &= score >= np.partition(score, len(columns) - k, axis=1)[:, len(columns) - k, None]
            i, j = np.nonzero(alive)
            rows, ids, scores = np.concatenate((rows, at + i)), np.concatenate((ids, c.ids[columns[j]])), np.concatenate((scores, s[i, j].astype(np.int64)))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = rank == k - 1
        least[rows[last]] = np.maximum(least[rows[last]], scores[last])
        rows, ids, scores = rows[rank < k], ids[rank < k], scores[rank < k]
    return rows, ids, scores


_PACKED = "dim int, ids binary, narrow boolean, data binary, high array<double>, low array<double>"


def packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of vectors of one length, of about so many components, those of large norm first: their ids, components, and
    the highest and lowest of their finest statistics (high, low)."""
    df = df.where("vec_id IS NOT NULL AND ints IS NOT NULL").select("vec_id", "ints", F.size("ints").alias("dim"))
    norm = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    n = max(1, -(-(df.agg(F.sum(F.greatest("dim", F.lit(1)))).first()[0] or 0) // size))
    dealt = df.repartitionByRange(n, F.col("dim"), norm.desc(), "vec_id").withColumn(name, F.spark_partition_id())

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        flat = t.column("ints").combine_chunks().flatten().to_numpy()
        x = flat.reshape(t.num_rows, -1)
        narrow = bool(np.abs(flat).max(initial=0) < 1 << 31)
        finest = stats(x.astype(np.float64), LEVELS[-1])
        one = lambda v, kind: pa.array([v], kind)
        return pa.table({name: one(key[0].as_py(), pa.int32()), "dim": one(key[1].as_py(), pa.int32()), "ids": one(t.column("vec_id").to_numpy().tobytes(), pa.binary()), "narrow": one(narrow, pa.bool_()), "data": one((x.astype(np.int32) if narrow else x).tobytes(), pa.binary()), "high": one(finest.max(0), pa.list_(pa.float64())), "low": one(finest.min(0), pa.list_(pa.float64()))})

    return written(dealt.groupBy(name, "dim").applyInArrow(pack, f"{name} int, {_PACKED}"))


def may_meet(q: dict, c: dict, least: float) -> bool:
    """Whether any pair of two blocks can reach the least score, by the extremes of their finest statistics."""
    corners = np.stack([np.array(q[a]) * np.array(c[b]) for a in ("high", "low") for b in ("high", "low")])
    bound = corners.max(0).sum()
    return bound + 1e-6 * abs(bound) + 0.5 >= least


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest inner product for each query, ties to the smaller vec_id.

    Inputs are (vec_id, ints: array<long>). Vectors are packed in blocks with the extremes of their segment statistics, large norms first.
    Each block of queries meets the first block of candidates, which gives every query a k-th best score to start from;
    block pairs whose extremes cannot reach the least of these are never sent. The others meet in runs of candidate
    blocks, from coarse bounds to fine ones to exact scores; a task keeps k per query, and a window ranks what tasks keep.
    A candidate is sent once for each block of queries, which is eight times its own block, and a block of queries once for
    each run, so what is sent of either is about the same.

    Only vectors of one length meet. Repeated candidate rows each count; rows that repeat a query's id are ranked together;
    a query's own id is never its result; null ids and null vectors take no part. Empty tables give no rows.
    """
    q, c = packed(queries, QUERY_SIZE, "qb"), packed(candidates, BLOCK_SIZE, "cb")
    first = c.join(c.groupBy("dim").agg(F.min("cb").alias("cb")), ["dim", "cb"], "left_semi")
    names = {x: f"c_{x}" for x in first.columns if x != "dim"}

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine, theirs = Block.of(row), Block.of({x: row.get(f"c_{x}") for x in names})
                least = np.full(len(mine.ids), -np.inf)
                rows, ids, scores = block_top(mine, [theirs], k, least)
                yield pa.RecordBatch.from_pylist([{"qb": row["qb"], "dim": row["dim"], "least": least.tobytes(), "lowest": float(least.min()), "query_id": mine.ids[rows].tolist(), "vec_id": ids.tolist(), "score": scores.tolist()}], schema=pa.schema([("qb", pa.int32()), ("dim", pa.int32()), ("least", pa.binary()), ("lowest", pa.float64()), *((n, pa.list_(pa.int64())) for n in ("query_id", "vec_id", "score"))]))

    seeded = written(q.join(first.withColumnsRenamed(names), "dim").repartition("qb", "dim").mapInArrow(seed, "qb int, dim int, least binary, lowest double, query_id array<long>, vec_id array<long>, score array<long>"))
    start = seeded.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("t")).select("t.*")
    meta = q.select("qb", "dim", "high", "low").join(seeded.select("qb", "dim", "lowest"), ["qb", "dim"])
    n_q = (q.agg(F.max("qb")).first()[0] or 0) + 1
    others = c.join(first.select("cb", "dim"), ["cb", "dim"], "left_anti").select("cb", "dim", F.col("high").alias("c_high"), F.col("low").alias("c_low"))
    met = others.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(meta, ["qb", "dim"])

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_meet(r, {"high": r["c_high"], "low": r["c_low"]}, r["lowest"]) for r in batch.to_pylist()]
            yield batch.select(["qb", "cb", "dim"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(met.select("qb", "cb", "dim", "high", "low", "c_high", "c_low", "lowest").mapInArrow(open_pairs, "qb int, cb int, dim int"))
    pairs = pairs.withColumn("run", F.floor(F.col("cb") / min(RUN, 1 + pairs.count() // TASKS)).cast("int"))
    right = pairs.join(c.drop("high", "low"), ["cb", "dim"])
    left = pairs.select("qb", "run", "dim").distinct().join(q.drop("high", "low"), ["qb", "dim"]).join(seeded.select("qb", "dim", "least"), ["qb", "dim"])
    left = left.select(*(F.col(x).alias(x) for x in left.columns))  # columns of its own beside right's, which also stem from pairs

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            mine = Block.of(row)
            blocks = [Block.of(r) for r in sorted(right.to_pylist(), key=lambda r: r["cb"])]
            rows, ids, scores = block_top(mine, blocks, k, np.frombuffer(row["least"], np.float64).copy())
            out = [[mine.ids[rows]], [ids], [scores]]
        return pa.table({n: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    keys = ["qb", "run", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long").union(start)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component; null vectors and those with null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("ints"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v.where("vec_id % 20 = 0"), v)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
