"""MinHash near-dedup with HyperMinHash sketches: registers of leading zeros and mantissa bits, banded, then verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import chunks, components, mix, runs, skew_join, table, word_hashes, word_spans, written

SHINGLE, SIMILARITY = 5, 0.75
#: Registers of a sketch, bits of mantissa in a register, registers of a band: a pair at the threshold shares no band with probability 5e-6.
REGISTERS, MANTISSA, BAND = 128, 10, 4
BANDS = REGISTERS // BAND
#: How far below the threshold an estimate may fall and still be verified, in standard deviations.
SLACK = 5.0
_DIFFER = (1 - SIMILARITY) * 15 / 16
_SPREAD = np.sqrt(REGISTERS * _DIFFER * (1 - _DIFFER))
#: Registers that may differ in their four bits: in a pair that is verified at all, and in one that is most likely linked.
MOST, STRONG = REGISTERS * _DIFFER + SLACK * _SPREAD, REGISTERS * _DIFFER - 2 * _SPREAD
#: Members of a bucket or of a family that one task compares with each other; larger ones are split.
BUCKET_ROWS, FAMILY_ROWS = 2048, 2048
#: Second texts of a document's pairs in a task.
PIVOT_ROWS = 256


def shingles(n: np.ndarray, word: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles: runs of `size` words; a row of fewer words has one, its whole sequence."""
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(word))
    total = np.repeat(n, n)
    place = total - left
    padded = np.concatenate((word, np.zeros(size - 1, np.uint64)))
    h = np.zeros(len(word), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(word)], np.uint64(0))
    keep = (left >= size) | ((place == 0) & (total < size))
    h = mix(h + np.minimum(total, size).astype(np.uint64))
    return row[keep], h[keep]


def sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each chunk, the distinct shingles of each row, ascending."""
    for _, offsets, body in chunks(column):
        starts, ends, n = word_spans(offsets, body)
        row, h = shingles(n, word_hashes(body, starts, ends))
        cuts = np.searchsorted(row, np.arange(1, len(n)))
        yield [np.unique(x) for x in np.split(h, cuts)]


_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (16 bits each) of a set of hashes: of the least hash in each bucket, leading zeros and mantissa bits.

    A round deals all members to the buckets by their top bits; buckets that stay empty wait for further rounds under
    other hashes, and after two rounds take the least of all members under a hash of their own. A bucket is then equal in
    two sets exactly if the union's first least member lies in both, which has the Jaccard similarity as probability.
    """
    least = np.full(REGISTERS, ~np.uint64(0))
    empty = np.ones(REGISTERS, bool)
    shift = np.uint64(64 - (REGISTERS - 1).bit_length())
    for turn in range(2):
        h = np.sort(mix(s + _SEEDS[turn]))
        at = np.searchsorted(h, np.arange(REGISTERS, dtype=np.uint64) << shift)
        bucket = np.append(h, np.uint64(0))[at] >> shift
        new = empty & (at < len(h)) & (bucket == np.arange(REGISTERS))
        least[new] = h[at[new]] << np.uint64(64 - int(shift)) | np.uint64(turn)
        empty &= ~new
        if not empty.any():
            break
    rest = np.flatnonzero(empty)
    for part in np.array_split(rest, max(1, len(rest) * len(s) >> 18)):
        least[part] = mix(s[None, :] ^ _SEEDS[part][:, None]).min(1)
    zeros = 63 - np.floor(np.log2(np.maximum(least.astype(np.float64), 1))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    tail = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)


def nibbles(x: np.ndarray) -> np.ndarray:
    """Four hashed bits of each register, two registers to a byte."""
    four = (mix(x.astype(np.uint64) + np.uint64(3)) & np.uint64(15)).astype(np.uint8)
    return four[::2] << np.uint8(4) | four[1::2]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), print (a digest of the set), registers and bits (four hashed bits of each register)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, r, bits = [], [], [], [], []
            for chunk in sets(batch.column("text")):
                for s in chunk:
                    n.append(len(s))
                    a.append(np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0))
                    b.append(np.add.reduce(mix(s + np.uint64(2))) if len(s) else np.uint64(0))
                    x = registers(s) if len(s) else None
                    r.append(x.tobytes() if x is not None else None)
                    bits.append(nibbles(x).tobytes() if x is not None else None)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), as_long(a), as_long(b), pa.array(r, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "print1", "print2", "registers", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print1 long, print2 long, registers binary, bits binary")


def _unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many registers differ in their four bits, row by row."""
    z = x ^ y
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    return np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def _bucket_links(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, bits: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, row, strong) of each bucket that may be similar by size and by bits, as a forest; rows are sorted by key.

    The forest starts from the given trees and takes strong pairs first. No pair of it is dropped later, so rows of one tree
    stay in one family, where full sets decide.
    """
    fits = lambda i, j: np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * 75
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    two = starts[ends - starts == 2]
    differ = np.where(fits(two, two + 1) & (trees[two] != trees[two + 1]), _unequal(bits[two], bits[two + 1]), REGISTERS)
    left, right, strong = [two[differ <= MOST]], [two[differ <= MOST] + 1], [differ[differ <= MOST] <= STRONG]
    for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
        # a pivot meets all rows; rows of other trees are pivots in turn until every pair across trees was met
        tree = np.unique(trees[a:b], return_inverse=True)[1]
        place = np.arange(b - a)
        for most in (STRONG, MOST):
            for p in range(b - a - 1):
                others = np.flatnonzero((tree != tree[p]) & (place > p))
                if not len(others):
                    if (tree == tree[0]).all():
                        break
                    continue
                others = others[fits(a + p, a + others)]
                near = others[_unequal(bits[[a + p]], bits[a + others]) <= most]
                if len(near):
                    left.append(np.full(len(near), a + p))
                    right.append(a + near)
                    strong.append(np.full(len(near), most == STRONG))
                    tree[np.isin(tree, tree[near])] = tree[p]
    i, j = np.concatenate(left), np.concatenate(right)
    return docs[i], docs[j], np.concatenate(strong)


def _joined(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, strong), a < b, from rows (key, doc_id, n, bits, tree): the forests of all buckets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            t = t.combine_chunks()
            keys, docs, sizes, trees = (t.column(c).to_numpy() for c in ("key", "doc_id", "n", "tree"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(keys), -1)
            a, b, strong = _bucket_links(keys, docs, sizes, bits, trees)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), strong], 1), axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2] > 0)], ["a", "b", "strong"])

    dealt = rows.select("key", "doc_id", "n", "bits", "tree").repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(link, "a long, b long, strong boolean").where("a <> b").groupBy("a", "b").agg(F.max("strong").alias("strong"))


def banded(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n, bits): a row for each band of each representative; key tells the band and its registers."""
    width = 2 * BAND
    band = lambda k: F.xxhash64(k, F.substring(F.col("registers"), k * width + 1, F.lit(width)))
    return reps.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"), "doc_id", "n", "bits")


def candidates(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b, strong) of rows (doc_id, n, registers, bits) that share a band and may be similar by their bits, as a forest of each band's bucket.

    A bucket of more than BUCKET_ROWS rows is split. Its rows are first held against its smallest document, and what is
    confirmed on full sets joins up; the largest group then falls into parts that need not meet each other, the rest into
    parts that meet all. A task holds two parts, and a bucket of one kind of text costs its own length.
    """
    rows = banded(reps)
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"))
    hot = written(sizes.where(F.col("rows") > BUCKET_ROWS).select("key"))
    if hot.isEmpty():
        return _joined(rows.withColumn("tree", F.col("doc_id")))
    full = written(rows.join(hot, "key", "left_semi"))
    pivot = full.groupBy("key").agg(F.min_by(F.struct(F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("bits").alias("pbits")), "doc_id").alias("s")).select("key", "s.*")

    strong = STRONG  # as it stands in the driver

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in ("bits", "pbits"))
            yield t.select(["p", "doc_id"]).filter(pa.array(_unequal(x, y) <= strong))

    stars = full.join(pivot, "key").where("doc_id <> p").select("p", "doc_id", "bits", "pbits").mapInArrow(near, "p long, doc_id long")
    stars = stars.groupBy(F.col("doc_id").alias("b")).agg(F.min("p").alias("a")).select("a", "b")
    found = written(confirmed(docs, written(stars)))
    joined = written(components(found))
    copies = written(full.groupBy("doc_id").agg(F.count("*").alias("copies")).join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("tree")))
    full = written(full.join(copies, "doc_id"))
    cells = split_cells(full, BUCKET_ROWS).select(F.col("cell").alias("key"), "doc_id", "n", "bits", "tree")
    cold = rows.join(hot, "key", "left_anti").withColumn("tree", F.col("doc_id")).select("key", "doc_id", "n", "bits", "tree")
    again = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("strong"))
    return _joined(cold.union(cells)).union(again).groupBy("a", "b").agg(F.max("strong").alias("strong"))


def split_cells(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, doc_id, tree, ...) dealt to tasks of two parts of about size: cell in place of key.

    The largest tree of a key falls into parts that need not meet each other; the other rows, the rest, into parts that
    meet all. A group that hangs together so costs its length, and only what does not is held against everything.
    """
    trees = rows.groupBy("key", "tree").agg(F.count("*").alias("rows"))
    top = trees.groupBy("key").agg(F.max_by("tree", F.struct("rows", "tree")).alias("top"), F.max("rows").alias("most"), F.sum("rows").alias("all"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    split = rows.join(top.select("key", "top", parts(F.col("most")).alias("tops"), parts(F.col("all") - F.col("most")).alias("rests")), "key")
    is_top = F.col("tree") == F.col("top")
    split = split.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.when(is_top, F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    with_rest = F.transform(up_to(F.col("rests")), lambda r: F.when(is_top, F.struct(F.lit(0).alias("kind"), F.col("part").alias("i"), r.alias("j"))).otherwise(F.struct(F.lit(1).alias("kind"), F.least("part", r).alias("i"), F.greatest("part", r).alias("j"))))
    with_top = F.when(is_top, F.array().cast("array<struct<kind:int,i:int,j:int>>")).otherwise(F.transform(up_to(F.col("tops")), lambda t: F.struct(F.lit(0).alias("kind"), t.alias("i"), F.col("part").alias("j"))))
    cells = split.withColumn("at", F.explode(F.concat(with_rest, with_top)))
    return cells.withColumn("cell", F.xxhash64("key", "at.kind", "at.i", "at.j")).drop("key", "at", "top", "tops", "rests", "part")


def exact_links(ids: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a family as a forest (a, b), found by search: each document met looks up the unmet ones that hold its shingles."""
    order = np.argsort([-len(s) for s in own], kind="stable")
    ids, own = ids[order], [own[k] for k in order]
    size = np.array([len(s) for s in own])
    left, right = [], []
    unmet = np.ones(len(own), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        who = np.flatnonzero(unmet)
        h = np.concatenate([own[k] for k in who]) if len(who) else np.empty(0, np.uint64)
        of = np.repeat(who, size[who])
        by = np.argsort(h, kind="stable")
        return h[by], of[by]

    h, of = index()
    held = len(own)
    queue: list[int] = []
    for first in range(len(own)):
        if not unmet[first]:
            continue
        unmet[first] = False
        queue.append(first)
        while queue:
            k = queue.pop()
            if unmet.sum() < held // 2:
                h, of = index()
                held = int(unmet.sum())
            if not held:
                queue.clear()
                break
            lo, hi = np.searchsorted(h, own[k], "left"), np.searchsorted(h, own[k], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            shared = np.bincount(of[at], minlength=len(own))
            near = np.flatnonzero(unmet & (100 * shared >= 75 * (size + size[k] - shared)) & (shared > 0))
            if len(near):
                left.append(np.full(len(near), ids[k]))
                right.append(ids[near])
                unmet[near] = False
                queue.extend(near.tolist())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def searched(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) on full sets among the documents of each cell (doc_id, cell), as forests; docs: rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "cell"):
            t = t.combine_chunks()
            cell, ids = t.column("cell").to_numpy(), t.column("doc_id").to_numpy()
            own = [s for c in t.column("text").chunks for part in sets(c) for s in part]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            out = [exact_links(ids[a:b], own[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["a", "b"])

    # no side has a proven bound, and the plan is the same at every size
    dealt = docs.join(cells.select("doc_id", "cell").hint("merge"), "doc_id").select("cell", "doc_id", "text").repartition("cell").sortWithinPartitions("cell", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked on full sets; docs: rows (doc_id, text).

    The second texts of a document's pairs meet the first in its task; a document of many pairs has several tasks.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("copies")).withColumn("parts", F.ceil(F.col("copies") / PIVOT_ROWS))
    cell = skew_join(pairs.select("a", "b"), degree, ["a"], pairs.count(), "inner").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("cell"))
    needs = cell.select(F.col("b").alias("doc_id"), "cell", "a", F.lit(1).alias("role")).union(cell.select(F.col("a").alias("doc_id"), "cell", "a", F.lit(0).alias("role")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "cell"):
            t = t.combine_chunks()
            cell, role, first, ids = (t.column(c).to_numpy() for c in ("cell", "role", "a", "doc_id"))
            own = [s for c in t.column("text").chunks for part in sets(c) for s in part]
            size = np.array([len(s) for s in own])
            out = []
            for p in np.flatnonzero(role == 0):
                lo, hi = np.searchsorted(cell, cell[p], "left"), np.searchsorted(cell, cell[p], "right")
                k = lo + np.flatnonzero((role[lo:hi] == 1) & (first[lo:hi] == first[p]))
                if not len(k) or not size[p]:
                    continue
                flat = np.concatenate([own[x] for x in k])
                at = np.minimum(np.searchsorted(own[p], flat), size[p] - 1)
                shared = np.bincount(np.repeat(np.arange(len(k)), size[k]), own[p][at] == flat, len(k)).astype(np.int64)
                k = k[(100 * shared >= 75 * (size[p] + size[k] - shared)) & (shared > 0)]
                out.append(np.stack([np.full(len(k), first[p]), ids[k]]))
            if out:
                a, b = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = docs.join(needs.hint("merge"), "doc_id").select("cell", "role", "a", "doc_id", "text").repartition("cell").sortWithinPartitions("cell", "role")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) on full sets whose components are those of all links among the representatives (doc_id, n, registers, bits).

    Candidate pairs fall into families, and every pair of a family is decided on full sets. A family of at most FAMILY_ROWS
    is one task's. In a larger one, each document is first held against the smallest that its bits make likely; the largest
    group confirmed so need not be searched within, and the rest meets all, part by part.
    """
    pairs = written(candidates(docs, reps))
    families = written(components(pairs))
    sizes = families.groupBy("component").agg(F.count("*").alias("members"))
    large = written(sizes.where(F.col("members") > FAMILY_ROWS).select("component"))
    cells = families.select(F.col("node").alias("doc_id"), F.col("component").alias("cell"))
    if large.isEmpty():
        return searched(docs, cells)
    # families above FAMILY_ROWS number up to one in FAMILY_ROWS documents, which is no fixed bound: no broadcast
    small = cells.join(large.withColumnRenamed("component", "cell"), "cell", "left_anti")
    members = written(families.join(large, "component", "left_semi"))
    anchors = pairs.join(members.select(F.col("node").alias("b")), "b", "left_semi").groupBy("b").agg(F.coalesce(F.min(F.when(F.col("strong"), F.col("a"))), F.min("a")).alias("a"))
    found = written(confirmed(docs, written(anchors.select("a", "b"))))
    joined = components(found).select("node", F.col("component").alias("tree"))
    rows = members.join(joined, "node", "left").select(F.col("component").alias("key"), F.col("node").alias("doc_id"), F.coalesce("tree", "node").alias("tree"))
    return searched(docs, small.select("doc_id", "cell").union(split_cells(written(rows), FAMILY_ROWS // 2).select("doc_id", "cell"))).union(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Equal sets are one class, known by its smallest doc_id. Classes are sketched, banded, compared by four bits of
    each register, and links are confirmed on full sets: 100 * intersection >= 75 * union. Components join linked classes;
    copies take the component of their class and are no part of that search.

    Null, empty and blank texts have no shingles and are linked with nothing, as are rows without doc_id (component_id
    null, kept). Rows that repeat a doc_id are one document: equal ones are one class, different texts are both linked
    under that id. Each input row gives one row; an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(sketches(rows))
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    prints = ["n", "print1", "print2"]
    classes = written(known.groupBy(*prints).agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("registers", "bits"), "doc_id").alias("s"), F.count("*").alias("copies")).select(*prints, "doc_id", "copies", "s.*"))
    links = linked(rows.where("doc_id IS NOT NULL"), classes)
    # a document with two texts stands in two classes and links them
    print_ = F.struct(*prints)
    twice = known.groupBy("doc_id").agg((F.min(print_) != F.max(print_)).alias("differ")).where("differ").select("doc_id")
    same = known.select("doc_id", *prints).join(twice, "doc_id", "left_semi").join(classes.select(*prints, F.col("doc_id").alias("class")), prints).select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    joined = components(links.union(same))
    labels = classes.join(joined, classes["doc_id"] == joined["node"], "left").select(*prints, F.coalesce("component", "doc_id").alias("component_id"), "copies")
    total = known.count()
    out = skew_join(known.select("doc_id", *prints), labels, prints, total, "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = base.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
