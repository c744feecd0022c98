"""Merkle dataset manifest: hash trees by slot pivot, inclusion proofs of every row, and a check of altered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import table, written
from stormsift.llm.url_filter import lower_ascii

FANOUT = 8
#: Leaves that a task of the range sort holds about, until there are MOST tasks; longer lists give larger tasks.
LEAVES, MOST = 1 << 14, 20_000
#: Runs (tasks times groups) of the range sort that are broadcast at most; more are joined by shuffle.
RUNS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"c{k}" for k in range(FANOUT)]
_NOTHING = lambda: F.lit(bytearray())


def joined(parts: list[Column]) -> Column:
    """Digests one after the other, missing ones left out."""
    return F.concat(*(F.coalesce(p, _NOTHING()) for p in parts)) if parts else _NOTHING()


def hashed(digests: Column) -> Column:
    """Digest (32 bytes) of concatenated digests, which are hashed as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(text, fields)), 256))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds at (place within group g by order, from 0) and n (rows of the group) to a written table.

    One sort by ranges of (g, order) over all groups: a group that holds most rows spans many tasks. Rows that are equal
    in all of that are interchangeable and spread by a random number. Places within a task are counted as it is written;
    what stands before a task in its group comes from the counts of (task, group), one row for each.
    """
    parts = min(MOST, max(1, -(-nodes.count() // LEAVES)))
    ranged = nodes.withColumn("_salt", F.rand(11)).repartitionByRange(parts, "g", *order, "_salt").sortWithinPartitions("g", *order).drop("_salt")
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    w = W.partitionBy("g")  # tasks that hold rows of the group, no rows
    runs = placed.groupBy("_part", "g").agg(F.min("_id").alias("_first"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("_part", "g", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(w).alias("n")))
    runs = F.broadcast(runs) if runs.count() <= RUNS else runs.hint("merge")
    return placed.join(runs, ["_part", "g"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def grown(leaves: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Levels of all trees: the leaves (g, at, n, h and what is carried), then tables of parents (g, at, n, h, c0..c7).

    A level is one grouping by parent, in which conditional aggregates spread the children into slots; the hash is that of
    the slots in order. Keys are parents, so no group has more than 8 rows. n counts the group's nodes of the level; a
    group ends where it has one.
    """
    levels = [leaves]
    size = leaves.agg(F.max("n")).first()[0] or 0
    while size > 1:
        child = F.struct("h", *(carried if len(levels) == 1 else []))
        slot = F.col("at") % FANOUT
        up = levels[-1].where("n > 1").groupBy("g", F.expr(f"at div {FANOUT}").alias("at"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
        up = up.agg(*(F.max(F.when(slot == k, child)).alias(c) for k, c in enumerate(_SLOTS)))
        levels.append(written(up.withColumn("h", hashed(joined([F.col(c)["h"] for c in _SLOTS])))))
        size = -(-size // FANOUT)
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(g, depth, subroot): the last node of each group."""
    ends = [x.where("n = 1").select("g", F.lit(k).alias("depth"), F.col("h").alias("subroot")) for k, x in enumerate(levels)]
    out = ends[0]
    for x in ends[1:]:
        out = out.union(x)
    return out


PATH = "array<struct<l:binary,r:binary>>"


def climbed(levels: list[DataFrame], tops: DataFrame, carried: list[str], given: list[str]) -> DataFrame:
    """(g, h, carried, given, path) of each leaf; tops are (g, depth, path, given) of the trees' last nodes.

    path holds, level by level from the leaf up, the siblings left and right: a parent's slots without the own one. It is
    built from the top down, so that what many leaves share is put together once for each parent.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        own = carried if k == 0 else []
        ends = levels[k].where("n = 1").join(tops.where(F.col("depth") == k).drop("depth").hint("merge"), "g").select("g", "at", "h", *own, *given, "path")
        if above is None:
            above = ends
            continue
        h = [F.col(c)["h"] for c in _SLOTS]
        kids = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(s).cast("long").alias("slot"), F.col(c).alias("child"), joined(h[:s]).alias("l"), joined(h[s + 1 :]).alias("r"))) for s, c in enumerate(_SLOTS)))
        met = levels[k + 1].drop("n", "h").join(above.drop("h").hint("merge"), ["g", "at"])
        met = met.select("g", F.col("at").alias("up"), *given, F.col("path").alias("rest"), F.explode(F.array_compact(kids)).alias("x"))
        met = met.select("g", (F.col("up") * FANOUT + F.col("x.slot")).alias("at"), *(F.col(f"x.child.{c}") for c in ("h", *own)), *given, F.concat(F.array(F.struct("x.l", "x.r")), "rest").alias("path"))
        above = met.unionByName(ends)
    return above.drop("at")


def merkle_proofs(docs: DataFrame, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path and folded_root of each row (digests as bytes), by one tree per lang and one over these trees.

    altered is the text to check a row with: the leaf of the altered row climbs the original path to folded_root, which
    equals root only if the row is the same; a null where there is nothing to check otherwise (the original leaf then
    climbs).

    Rows with one doc_id stand in order of their leaves, and rows that are equal in all fields are proved apart, each at
    its place. Null doc_ids come first; null lang is a tree of its own, before the others. Null fields hash as `-`, empty
    texts as `0:`, very long ones whole. A tree of one leaf has that leaf as subroot, one lang its subroot as root, and an
    empty table gives no rows. Other columns are not read.
    """
    kinds = dict(zip(FIELDS, ("long", "string", "string", "long", "string"), strict=True))
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), altered.alias("other"))
    fields = [F.col(c) for c in FIELDS]
    group = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    other = F.when(F.col("other").isNotNull(), leaf([*fields[:-1], F.col("other")]))
    leaves = written(rows.select(group.alias("g"), "doc_id", leaf(fields).alias("h"), other.alias("other")))
    levels = grown(numbered(leaves, ["doc_id", "h"]), ["doc_id", "other"])
    ends = written(subroots(levels))
    crown = grown(numbered(ends.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("depth").alias("of"), F.col("subroot").alias("h")), ["name"]), ["name", "of"])
    root = subroots(crown).select("g", "depth", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
    tops = climbed(crown, root, ["name", "of"], ["root"]).select(F.col("name").alias("g"), F.col("of").alias("depth"), F.col("h").alias("subroot"), "root", "path")
    out = climbed(levels, written(tops), ["doc_id", "other"], ["subroot", "root"])
    folded = F.aggregate("path", F.coalesce("other", "h"), lambda h, s: hashed(F.concat(s["l"], h, s["r"])))
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", folded.alias("folded_root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    check = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    p = merkle_proofs(docs, F.when(check, lower_ascii(F.col("text").cast("string"))))
    text = lambda c: F.lower(F.hex(c))
    siblings = F.aggregate("path", _NOTHING(), lambda a, s: F.concat(a, s["l"], s["r"]))
    return p.select("doc_id", *(text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), text(hashed(siblings)).alias("proof_sha256"), text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _op11_sql(levels: int = 7) -> str:
    """The same by joins of each node with its run's others; enough levels for 8^levels leaves of a lang and as many langs."""
    field = lambda c: f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')"
    own = " || ".join(map(field, FIELDS[:-1]))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the decimal digits, bit by bit (its polynomial reversed is 0xEDB88320)
    bits = "flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    ctes = [
        f"raw AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({own} || {field('text')}) AS h, CASE WHEN {crc} % 3 = 0 AND text IS NOT NULL THEN sha256({own} || {field(low)}) END AS other FROM documents)",
        "t0 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM raw WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, h))",
        "f0 AS (SELECT row_number() OVER () AS i, doc_id, h AS leaf, coalesce(other, h) AS fold, '' AS proof, g, pos, n, h FROM t0)",
    ]

    def climb(name: str, start: str) -> list[str]:
        out = []
        for k in range(levels):
            below = f"{name}{k}" if k else start
            out += [
                f"{name}n{k} AS (SELECT DISTINCT g, pos, n, h FROM {below})",
                f"{name}p{k} AS (SELECT g, pos // 8 AS up, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}n{k} WHERE n > 1 GROUP BY ALL)",
                f"{name}s{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r FROM {name}n{k} a JOIN {name}n{k} b ON a.g = b.g AND a.pos // 8 = b.pos // 8 GROUP BY ALL)",
                f"{name}{k + 1} AS (SELECT f.i, f.doc_id, f.leaf, CASE WHEN f.n > 1 THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold, CASE WHEN f.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END AS proof, f.g, f.pos // 8 AS pos, (f.n + 7) // 8 AS n, coalesce(p.h, f.h) AS h FROM {below} f JOIN {name}s{k} s ON f.g = s.g AND f.pos = s.pos LEFT JOIN {name}p{k} p ON f.g = p.g AND f.pos // 8 = p.up)",
            ]
        return out

    ctes += climb("f", "f0")
    ctes.append(f"r0 AS (SELECT i, doc_id, leaf, fold, proof, '' AS g, dense_rank() OVER (ORDER BY g) - 1 AS pos, (SELECT count(DISTINCT g) FROM f{levels}) AS n, h FROM f{levels})")
    ctes += climb("r", "r0")
    return f"WITH {', '.join(ctes)} SELECT a.doc_id, a.leaf, b.h AS subroot, a.h AS root, sha256(a.proof) AS proof_sha256, a.fold AS folded_root, a.fold = a.h AS verified FROM r{levels} a JOIN f{levels} b ON a.i = b.i"


OP11_SQL = _op11_sql()
