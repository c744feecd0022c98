"""Quality rules with thresholds learned per language and source from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import WORD_PATTERN, skew_join, table, written

#: Judged shares as (part, whole), and the least spread of a group's share, in sketch buckets: what a document may owe to
#: chance. A group's fence stands SPREAD spreads above its upper quartile.
SHARES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
LEAST = {"symbols": 34, "capitals": 34, "repeats": 200, "dup_lines": 400}
SPREAD = 3
#: Buckets of a share in a sketch, and documents that a group's parent counts for in the group's limit.
FINE, PARENT = 10_000, 20
#: Bytes of text that a task counts words of about; its windows take some twenty times that.
TASK_BYTES = 8 << 20


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and counts of each whole text, one row per input row.

    The rows are dealt once by a row number, to as many tasks as their bytes ask for, so that a task's share, and the memory
    of its windows, stays the same however much there is. Each then becomes one row per window of three words plus one that carries
    the other counts; windows are counted by (row, hash) and places by row, both within that partitioning, so words
    never cross the network and a document costs its own length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartition(max(1, -(-size // TASK_BYTES)), "row")
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN))
    counts = F.struct(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    at = F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 3, F.lit(-1))))
    # the counts stand below the explode: what follows it then is one generated loop that copies neither text nor words
    places = rows.select("row", "words", counts.alias("counts")).select("row", "words", "counts", at.alias("at"))
    three = F.xxhash64(*(F.get("words", F.col("at") + k) for k in range(3)))
    places = places.select("row", "at", F.when(F.col("at") >= 0, three).alias("h"), F.when(F.col("at") < 0, F.col("counts")).alias("counts"))
    again = places.withColumn("n", F.count("*").over(W.partitionBy("row", "h"))).where("n > 1 OR at < 0")
    before = F.lag("at").over(W.partitionBy("row").orderBy("at"))
    new = again.withColumn("new", F.when(F.col("at") < 0, 0).when(before < 0, 3).otherwise(F.least(F.lit(3), F.col("at") - before)))
    done = new.groupBy("row").agg(F.sum("new").alias("n_repeat_words"), F.first("counts", ignorenulls=True).alias("c"))
    return done.select("c.*", F.col("n_repeat_words").cast("long").alias("n_repeat_words"))


def _share(part: Column, whole: Column, scale: int) -> Column:
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(F.lit(0)).cast("long")


def _key(name: str) -> Column:
    """A null group is a group of its own."""
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name)))


def with_shares(f: DataFrame) -> DataFrame:
    return f.withColumns({k: _share(F.col(a), F.col(b), FINE) for k, (a, b) in SHARES.items()} | {"lang_key": _key("lang"), "source_key": _key("source")})


def sketch(f: DataFrame) -> DataFrame:
    """(lang_key, source_key, feature, bucket, n): counts per bucket of the shares. Sums of n merge sketches exactly; a quantile is off by a bucket at most."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("bucket")) for k in SHARES)))
    return f.select("lang_key", "source_key", pairs.alias("p")).groupBy("lang_key", "source_key", "p.feature", "p.bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per group and feature, from the merged sketch: by, feature, size, fence. At most FINE + 1 buckets meet in a window.

    The spread is that of the quartiles; where they coincide, that from the upper quartile to the ninth decile, a third
    more; and never less than LEAST.
    """
    merged = sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "feature")
    up = merged.select(*by, "feature", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("rank"), F.sum("n").over(w).alias("size"))
    q = lambda p, of=4: F.min(F.when(F.col("rank") * of >= F.col("size") * p, F.col("bucket")))
    found = up.groupBy(*by, "feature").agg(F.first("size").alias("size"), q(1).alias("q1"), q(3).alias("q3"), q(9, 10).alias("q90"))
    spread = F.when(F.col("q1") < F.col("q3"), SPREAD * (F.col("q3") - F.col("q1"))).otherwise((SPREAD + 1) * (F.col("q90") - F.col("q3")))
    least = F.create_map(*(F.lit(x) for pair in LEAST.items() for x in pair))[F.col("feature")]
    fence = F.col("q3") + F.greatest(spread, SPREAD * least)
    return found.select(*by, "feature", "size", fence.cast("long").alias("fence"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang_key, source_key, copies, max_* per feature): each group's limits, with the number of its documents.

    A limit is the group's fence averaged with its parent's limit, which weighs as much as PARENT documents: the parent of
    a source is its language, that of a language is all documents. A small group so leans on its parent, and a large one
    goes by its own sketch.
    """
    own = fences(sketches, ["lang_key", "source_key"])
    lang = fences(sketches, ["lang_key"]).select("lang_key", "feature", F.col("size").alias("lang_size"), F.col("fence").alias("lang_fence"))
    every = fences(sketches, []).select("feature", F.col("fence").alias("all_fence"))
    lean = lambda size, fence, parent: F.expr(f"({size} * {fence} + {PARENT} * {parent}) div ({size} + {PARENT})")
    best = lang.join(F.broadcast(every), "feature").withColumn("lang_limit", lean("lang_size", "lang_fence", "all_fence"))  # every: a row per feature
    best = own.join(best.select("lang_key", "feature", "lang_limit"), ["lang_key", "feature"]).withColumn("limit", lean("size", "fence", "lang_limit"))
    return best.groupBy("lang_key", "source_key").agg(F.max("size").alias("copies"), *(F.max(F.when(F.col("feature") == k, F.col("limit"))).alias(f"max_{k}") for k in SHARES))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, shares, limits, base_failed and kept of every row, with its doc_id, lang, source and text_hash (see judge)."""
    f = written(with_shares(text_features(docs)))
    out = skew_join(f, thresholds(sketch(f)), ["lang_key", "source_key"], f.count(), "inner")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = F.lit(False)
    for k in SHARES:
        odd = odd | (F.col(k) > F.col(f"max_{k}"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~odd})


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and the shares (ten-thousandths) of every document.

    Base: fails under 50 words, or if more than half of its words stand in repeated windows of three. Verdict: a document
    is rejected if a share (symbols and capitals of word characters, repeated words of words, equal lines of lines) is
    above the limit that its group's sketch sets (see thresholds). Groups are (language, source); nulls form groups of their own.

    Null or empty texts have no words and fail the base; an empty table gives no rows; repeated rows each give a row;
    columns other than doc_id, text, lang and source are not read.
    """
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *SHARES)


def group_limits(docs: DataFrame) -> DataFrame:
    """lang, source, n_docs and the limit of each share (ten-thousandths) of every group."""
    f = with_shares(text_features(docs))
    name = lambda c: F.when(F.col(c) != "", F.substr(F.col(c), F.lit(2)))
    return thresholds(written(sketch(f))).select(name("lang_key").alias("lang"), name("source_key").alias("source"), F.col("copies").alias("n_docs"), *(f"max_{k}" for k in SHARES))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def quality_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_limits(table(spark, sf_dir, "documents"))


_WS = r"[\x20\x09-\x0D]+"
_SHARES = ", ".join(f"CASE WHEN {b} > 0 THEN {a} * {FINE} // {b} ELSE 0 END AS {k}" for k, (a, b) in SHARES.items())
_LEAST = ", ".join(f"('{k}', {k}, {v})" for k, v in LEAST.items())


def _quartiles(by: int) -> str:
    q = lambda p, of: f"min(v) FILTER (r{by} * {of} >= n{by} * {p})"
    return f"any_value(n{by}) AS n, any_value(least) AS least, {q(1, 4)} AS a, {q(3, 4)} AS b, {q(9, 10)} AS d"


def _fence(t: str) -> str:
    return f"({t}.b + greatest(CASE WHEN {t}.a < {t}.b THEN {SPREAD} * ({t}.b - {t}.a) ELSE {SPREAD + 1} * ({t}.d - {t}.b) END, {SPREAD} * {t}.least))"


#: The whole operator in SQL, over a view named documents.
FEATURES_SQL = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD_PATTERN}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, least(3, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 3)) AS new FROM c WHERE n > 1),
rep AS (SELECT r, sum(new) AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD_PATTERN}')) AS ls FROM d),
f AS (SELECT d.r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS lk, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS sk,
        len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
s AS (SELECT *, {_SHARES} FROM f),
long AS (SELECT lk, sk, feature, v, least FROM s, LATERAL (VALUES {_LEAST}) AS t(feature, v, least)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lk, sk, feature ORDER BY v) AS r0, count(*) OVER (PARTITION BY lk, sk, feature) AS n0, row_number() OVER (PARTITION BY lk, feature ORDER BY v) AS r1,
           count(*) OVER (PARTITION BY lk, feature) AS n1, row_number() OVER (PARTITION BY feature ORDER BY v) AS r2, count(*) OVER (PARTITION BY feature) AS n2 FROM long),
q0 AS (SELECT lk, sk, feature, {_quartiles(0)} FROM ranked GROUP BY lk, sk, feature),
q1 AS (SELECT lk, feature, {_quartiles(1)} FROM ranked GROUP BY lk, feature),
q2 AS (SELECT feature, {_quartiles(2)} FROM ranked GROUP BY feature),
l1 AS (SELECT lk, feature, (q1.n * {_fence("q1")} + {PARENT} * {_fence("q2")}) // (q1.n + {PARENT}) AS lim FROM q1 JOIN q2 USING (feature)),
l0 AS (SELECT lk, sk, feature, q0.n, (q0.n * {_fence("q0")} + {PARENT} * l1.lim) // (q0.n + {PARENT}) AS lim FROM q0 JOIN l1 USING (lk, feature)),
wide AS (SELECT lk, sk, max(n) AS n_docs, max(lim) FILTER (feature = 'symbols') AS l1, max(lim) FILTER (feature = 'capitals') AS l2, max(lim) FILTER (feature = 'repeats') AS l3, max(lim) FILTER (feature = 'dup_lines') AS l4 FROM l0 GROUP BY lk, sk),
v AS (SELECT s.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (symbols > l1 OR capitals > l2 OR repeats > l3 OR dup_lines > l4) AS odd FROM s JOIN wide USING (lk, sk))
"""
OP5_SQL = f"WITH {FEATURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT odd) AS kept, symbols::BIGINT AS symbols, capitals::BIGINT AS capitals, repeats::BIGINT AS repeats, dup_lines::BIGINT AS dup_lines FROM v"
LIMITS_SQL = f"WITH {FEATURES_SQL} SELECT CASE WHEN lk <> '' THEN lk[2:] END AS lang, CASE WHEN sk <> '' THEN sk[2:] END AS source, n_docs, l1 AS max_symbols, l2 AS max_capitals, l3 AS max_repeats, l4 AS max_dup_lines FROM wide"
