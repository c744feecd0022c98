"""Secret scans: candidates by pattern, told apart by who owns them across the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import skew_join, table, written

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
#: (kind, pattern, group that is the value, least characters of it), in order. The first three are fixed values of the
#: query's contract; where a pattern is one run, {least,} stands for dropping shorter runs. opaque is the operator's own.
KINDS = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9_-]{16,}", 0, 16),
)
BASE = 3
#: An opaque value needs a letter, a digit and so many different characters.
VARIETY = 8
#: A value is a copied example if so many owners hold it, or several owners in so many repositories; else it looks live.
OWNERS, REPOSITORIES = 3, 8


def _found(number: int) -> Column:
    """Matches of one kind as structs kind, place, gap (characters since the match before), size, and the value's digest
    (null where the match fails) from columns w and v of that number and text. Matches do not overlap and are never empty,
    so a text is the pieces between them and the matches in turn."""
    _, pattern, _, least = KINDS[number]
    whole, value = F.col(f"w{number}"), F.col(f"v{number}")
    holds = lambda v: F.char_length(v) >= least
    if number >= BASE:
        holds = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= VARIETY)
    digest = F.transform(value, lambda v: F.when(holds(v), F.unhex(F.sha2(v, 256))))
    gaps = F.transform(F.split("text", pattern, -1), lambda s: F.char_length(s))
    both = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.transform(whole, lambda s: F.char_length(s)), lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    each = F.zip_with(both, digest, lambda b, d: F.struct(F.lit(number).alias("kind"), b["gap"].alias("gap"), b["size"].alias("size"), d.alias("value")))
    placed = F.transform(each, lambda x, i: x.withField("place", i))
    return F.when(F.size(whole) > 0, placed)


def secret_spans(docs: DataFrame, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows are doc_id and _row, a number for each row of docs; spans are _row, kind (number in KINDS), start,
    end (exclusive, in code points), owners, repositories and live.

    Candidates of all kinds are digested where they stand; digests are counted by distinct owners and repositories over
    the whole corpus, and the counts go back to every candidate. Values that many owners hold are examples that were
    copied; values of one owner look like live credentials. A value that holds much of the corpus is counted by parts
    first and answered by broadcast (skew_join). Values themselves are not written, only SHA-256. An opaque candidate that overlaps one of
    another kind is left out.

    Null text counts as empty. A null owner or repository is an owner or repository of its own. Repeated rows are scanned
    each and count once as owner; an empty table gives empty tables; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(owner).alias("owner"), named(repository).alias("repository"), text.alias("text"))
    wide = base.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"w{k}") for k, (_, p, _, _) in enumerate(KINDS)))
    wide = wide.select("*", *(F.when(F.size(f"w{k}") > 0, F.regexp_extract_all("text", F.lit(p), F.lit(g))).alias(f"v{k}") if g else F.col(f"w{k}").alias(f"v{k}") for k, (_, p, g, _) in enumerate(KINDS)))
    nothing = F.array().cast("array<struct<kind:int,gap:int,size:int,value:binary,place:int>>")
    rows = written(wide.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repository", F.concat(*(F.coalesce(_found(k), nothing) for k in range(len(KINDS)))).alias("found")))

    w = W.partitionBy("_row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # matches of one text
    met = rows.where(F.size("found") > 0).select("_row", "owner", "repository", F.inline("found"))
    met = met.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w)).withColumn("start", F.col("end") - F.col("size")).where("value IS NOT NULL")
    near = W.partitionBy("_row").orderBy("start")
    others = F.col("kind") < BASE
    before = F.max(F.when(others, F.col("end"))).over(near.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(others, F.col("start"))).over(near.rangeBetween(0, W.unboundedFollowing))
    free = others | (~F.coalesce(before > F.col("start"), F.lit(False)) & ~F.coalesce(after < F.col("end"), F.lit(False)))
    found = written(met.withColumn("free", free).where("free").select("_row", "kind", "start", "end", "value", "owner", "repository"))
    held = found.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repository").alias("repositories"), F.count("*").alias("copies"))
    told = skew_join(found.drop("owner", "repository"), held, ["value"], found.count(), "inner", grows=True)
    copied = (F.col("owners") >= OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= REPOSITORIES))
    return rows.select("_row", "doc_id"), told.select("_row", "kind", "start", "end", "owners", "repositories", (~copied).alias("live"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources, repositories documents. Spans of the operator's own kind are added where they look live."""
    rows, spans = secret_spans(table(spark, sf_dir, "documents"), "source", "doc_id")
    one = F.struct("start", "kind", "end", "live")
    per = spans.groupBy("_row").agg(F.sort_array(F.collect_list(one)).alias("s"))  # spans of one text
    out = rows.join(per.hint("merge"), "_row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")))
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    size = lambda f: F.size(F.filter("s", f)).cast("long")
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [size(of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return out.select("doc_id", *counts, F.sha2(text(F.filter("s", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), text(F.filter("s", lambda x: (x["kind"] < BASE) | x["live"])).alias("spans"), size(lambda x: x["live"]).alias("n_live"), size(lambda x: ~x["live"]).alias("n_copied"))


def _op13_sql() -> str:
    ctes = ["d AS (SELECT row_number() OVER () AS i, doc_id, coalesce('+' || source, '') AS owner, coalesce('+' || doc_id, '') AS repo, coalesce(text, '') AS text FROM documents)"]
    for k, (_, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        holds = f"length(v) >= {least}" if k < BASE else f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {VARIETY}"
        ctes += [
            f"m{k} AS (SELECT i, owner, repo, unnest(regexp_extract_all(text, '{p}')) AS w, unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(string_split_regex(text, '{p}')[:-2]) AS piece, unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) AS place FROM d WHERE regexp_matches(text, '{p}'))",
            f"p{k} AS (SELECT i, owner, repo, {k} AS kind, v, {holds} AS ok, length(w) AS size, sum(length(piece) + length(w)) OVER (PARTITION BY i ORDER BY place) AS stop FROM m{k})",
        ]
    every = " UNION ALL ".join(f"SELECT i, owner, repo, kind, v, stop - size AS start, stop FROM p{k} WHERE ok" for k in range(len(KINDS)))
    ctes += [
        f"c0 AS ({every})",
        f"c AS (SELECT * FROM c0 a WHERE kind < {BASE} OR NOT EXISTS (SELECT 1 FROM c0 b WHERE b.i = a.i AND b.kind < {BASE} AND b.start < a.stop AND a.start < b.stop))",
        f"h AS (SELECT v, NOT (count(DISTINCT owner) >= {OWNERS} OR (count(DISTINCT owner) > 1 AND count(DISTINCT (owner, repo)) >= {REPOSITORIES})) AS live FROM c GROUP BY v)",
        f"n AS (SELECT i, kind, start, live, ['{KINDS[0][0]}', '{KINDS[1][0]}', '{KINDS[2][0]}', '{KINDS[3][0]}'][kind + 1] || ':' || cast(start AS bigint) || ':' || cast(stop AS bigint) AS t FROM c JOIN h USING (v))",
    ]
    counts = ", ".join(f"count(n.i) FILTER (WHERE kind = {k}) AS n_{KINDS[k][0]}" for k in range(BASE))
    return f"WITH {', '.join(ctes)} SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < {BASE}), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < {BASE} OR live), '') AS spans, count(n.i) FILTER (WHERE live) AS n_live, count(n.i) FILTER (WHERE NOT live) AS n_copied FROM d LEFT JOIN n ON d.i = n.i GROUP BY d.i, d.doc_id"


OP13_SQL = _op13_sql()
