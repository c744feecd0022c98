"""URL filters: host-suffix and path-prefix expressions, joined on hash prefixes and confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import skew_join, table, written

#: (verdict, host, path, base): the base rules are fixed values of the query's contract; the others are the operator's own.
RULES = (
    ("allow", "com", "/", True),
    ("block", "example.com", "/en/", True),
    ("allow", "www.example.com", "/en/", True),
    ("block", "net", "/es/", True),
    ("block", "net", "/fr/", True),
    ("block", "spam-farm.example.org", "/", False),
    ("block", "spam-farm.example.net", "/", False),
    ("block", "cheap-pills.example.org", "/", False),
    ("block", "cheap-pills.example.net", "/", False),
)
#: Rules that are broadcast at most.
MOST_RULES = 100_000
#: Hex digits of the digest that the join compares first.
PREFIX = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _met(expanded: DataFrame, keyed: DataFrame) -> DataFrame:
    """Expressions with the rules of their prefix. Up to MOST_RULES rules are broadcast, counted first; with more, most URLs may
    still share the prefix of one rule (a whole top-level domain), so rules are packed by prefix and hot ones broadcast."""
    if keyed.count() <= MOST_RULES:
        return expanded.join(F.broadcast(keyed), "prefix")
    expanded = written(expanded.withColumnRenamed("copies", "urls"))
    packed = keyed.groupBy("prefix").agg(F.collect_list(F.struct(*(c for c in keyed.columns if c != "prefix"))).alias("rules"))  # rules whose digests begin alike
    packed = packed.join(expanded.groupBy("prefix").agg(F.count("*").alias("copies")), "prefix")
    met = skew_join(expanded, packed, ["prefix"], expanded.count(), "inner", grows=True)
    return met.select(*expanded.columns, F.inline("rules")).withColumnRenamed("urls", "copies")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds host, path, rule and verdict to each row of pages (page_id, url).

    Each distinct URL is expanded into its host suffixes (at dots, of no more labels than a rule's host has) times its path
    prefixes (of the lengths that rule paths have, so any rule path fits by plain prefix). Expressions meet rules on the first digits of their SHA-256, then
    the full digests must agree. The longest base rule wins and is named; where none fits, the operator's own rules give
    the verdict, else allow. Rules are (verdict, host, path, base); equally long ones: block wins.

    Null or malformed URLs have empty host and path, no rule, verdict allow. Rows are kept one for one, repeated ones
    too; other columns are not read. Without rules, every verdict is allow.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    r = rules.select("verdict", "base", F.concat("host", "path").alias("expr"), F.length("path").alias("size")).withColumn("digest", digest(F.concat(F.lit("h:"), F.col("expr"))))
    sizes = [x[0] for x in r.select("size").distinct().orderBy("size").collect()]  # distinct lengths of rule paths only
    keyed = r.select(F.substring("digest", 1, PREFIX).alias("prefix"), "digest", "verdict", "base", F.length("expr").alias("length"), F.col("expr"))

    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    parts = F.split(F.substring_index("host", ".", labels * -1), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    urls = rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("copies"))
    at = F.array(*(F.lit(x) for x in sizes)) if sizes else F.array().cast("array<int>")
    expanded = urls.withColumn("suffix", F.explode(suffixes)).withColumn("size", F.explode(at)).where(F.length("path") >= F.col("size"))
    expanded = expanded.select("host", "path", "copies", digest(F.concat(F.lit("h:"), F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("size")))).alias("found"))
    expanded = expanded.withColumn("prefix", F.substring("found", 1, PREFIX))
    met = _met(expanded, keyed.distinct()).where(F.col("found") == F.col("digest"))
    order = F.struct(F.col("base"), F.col("length"), (F.col("verdict") == "block"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("base", "expr", "verdict"), order).alias("best"), F.max("copies").alias("copies"))
    # rows without a host share one key and meet no rule: they take no part in the join
    out = skew_join(rows.where("host <> ''"), best, ["host", "path"], rows.count(), grows=True).unionByName(rows.where("host = ''"), allowMissingColumns=True)
    return out.select("page_id", "host", "path", F.when(F.col("best.base"), F.col("best.expr")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string, base boolean")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{v}', '{h}', '{p}', {str(b).lower()})" for v, h, p, b in RULES)
OP9_SQL = rf"""
WITH rules(verdict, rhost, rpath, base) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS i, page_id,
        CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
m AS (SELECT u.*, r.verdict, r.rhost || r.rpath AS rule, r.base,
        row_number() OVER (PARTITION BY i ORDER BY coalesce(r.base, false) DESC, length(r.rhost || r.rpath) DESC NULLS LAST) AS k
      FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, CASE WHEN base THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
