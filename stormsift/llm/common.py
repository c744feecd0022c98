"""Helpers that several operators share: Arrow text kernels, sized joins, lineage cuts, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.sources.io import kept as written

#: Bytes of text that a kernel holds as wide arrays at once; a longer document is one chunk of its own.
CHUNK_BYTES = 1 << 19

#: A key is hot if it holds more than one in HOT_KEYS of all rows, so there are fewer hot keys than that.
HOT_KEYS = 10_000

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ lineage and joins


def skew_join(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left", grows: bool = False) -> DataFrame:
    """big (of about so many rows) joined with small, which has one row a key and in `copies` the rows of big that hold it.

    Keys of more than one in HOT_KEYS of all rows number fewer than HOT_KEYS, so they are broadcast; the others meet by
    shuffle, where no key is large. small is written first, as three branches of the plan read it. grows says that small
    grows with big: then the shuffle is fixed in the plan, and Spark does not broadcast small while it happens to be short.
    """
    most, small = max(1, rows // HOT_KEYS), written(small)
    hot = F.broadcast(small.where(F.col("copies") > most).drop("copies"))
    cold = small.where(F.col("copies") <= most).drop("copies")
    cold = cold.hint("merge") if grows else cold
    return big.join(hot, on).unionByName(big.join(hot.select(on), on, "left_anti").join(cold, on, how))


# ------------------------------------------------------------------ text kernels


def filled(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of strings without nulls, not copied."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64), body


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about size bytes."""
    offsets, body = raw(filled(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, offsets[at : end + 1] - offsets[at], body[offsets[at] : offsets[end]]
        at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(offsets: np.ndarray, body: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row): maximal runs of bytes outside gap, never across rows."""
    if not len(body):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = gap[body]
    edge = np.empty(len(body) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[0] = edge[-1] = True
    first = edge[:-1]
    first[offsets[:-1][offsets[:-1] < len(body)]] = True
    starts = np.flatnonzero(first & ~space)
    after = np.empty(len(body), bool)
    after[:-1] = space[1:]
    after[-1] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words' bytes, A-Z as a-z if lower; the same wherever a word stands."""
    up, down = powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[body] * up[: len(body)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliced(column: pa.Array, rows: int) -> Iterator[pa.Array]:
    for at in range(0, len(column), rows):
        yield column.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of batches sorted by key: tables that hold whole groups, several small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        if held and held[-1].column(key)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); component is the smallest node reachable.

    Large-star and small-star steps in turn: every node hooks what it sees to the smallest node in sight, so the number
    of rounds follows the logarithm of a component's size. Hubs (nodes of more than one in HOT_KEYS edges) are joined by
    broadcast, so none gathers its edges in one task. Each round is written to the shared folder. Empty edges give no rows.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, seen = e.count(), None
    if not n:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("copies"))
        large = skew_join(both.where("b > a"), least, ["a"], 2 * n, "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
        small = skew_join(large, low, ["a"], n, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    star = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
