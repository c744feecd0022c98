"""Known failure patterns, incident signatures and similar incidents."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.functions.columns import family, half_up
from stormsift.functions.ordering import in_order
from stormsift.params import DEFAULT, PATTERNS, Params
from stormsift.sources.io import kept


def known_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(r), list(s)) for k, r, s in PATTERNS], "pattern_key string, root_types array<string>, symptom_types array<string>")


def match_patterns(members: DataFrame, alarms: DataFrame, roots: DataFrame, patterns: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(incident_id, pattern_key, confidence, matched_symptoms, symptom_share) of patterns that hold the root's type."""
    kinds = members.join(alarms.select("alarm_id", "alarm_type"), "alarm_id").groupBy("incident_id", "alarm_type").agg(F.count("*").alias("n"))
    own = roots.select("incident_id", "root_type").join(patterns.withColumn("root_type", F.explode("root_types")).drop("root_types"), "root_type")
    met = own.join(kinds, "incident_id").withColumn("is_symptom", F.array_contains("symptom_types", F.col("alarm_type")))
    s = met.groupBy("incident_id", "pattern_key", F.size("symptom_types").alias("of")).agg(
        (F.sum(F.when(F.col("is_symptom"), F.col("n")).otherwise(0)) / F.sum("n")).alias("mass"), F.sort_array(F.collect_set(F.when(F.col("is_symptom"), F.col("alarm_type")))).alias("matched_symptoms")
    )
    score = 0.55 + 0.30 * F.col("mass") + 0.15 * (F.size("matched_symptoms") / F.col("of"))
    return s.withColumn("raw", score).where(F.col("raw") >= p.pattern_threshold).select("incident_id", "pattern_key", half_up(F.col("raw"), 3).alias("confidence"), "matched_symptoms", half_up(F.col("mass"), 3).alias("symptom_share"))


def signatures(incidents: DataFrame, members: DataFrame, alarms: DataFrame, roots: DataFrame, run_id: str) -> DataFrame:
    kinds = members.join(alarms.select("alarm_id", "alarm_type"), "alarm_id").groupBy("incident_id", "alarm_type").agg(F.count("*").alias("n"))
    share = half_up(F.col("n") / F.sum("n").over(W.partitionBy("incident_id")), 4)
    histogram = kinds.select("incident_id", "alarm_type", share.alias("share")).groupBy("incident_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alarm_type", "share")))).alias("type_histogram"))
    i = incidents.join(roots.select("incident_id", "root_type", "root_service"), "incident_id").join(histogram, "incident_id")
    return i.select("incident_id", F.lit(run_id).alias("run_id"), F.col("start_us").alias("occurred_us"), "root_type", "root_service", "services", "locations", "type_histogram", "max_severity", "alarm_count", "duration_min")


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


_SIDE = ("incident_id", "run_id", "root_type", "root_service", "services", "locations", "type_histogram", "max_severity")


def _compared(m: DataFrame, *more: str) -> DataFrame:
    """(a, b, b_run, similarity, reasons) and what more is named, of pairs with columns a_ and b_ of both signatures."""
    root = F.when((F.col("a_root_type") != "") & (F.col("a_root_type") == F.col("b_root_type")), 1.0).when((F.col("a_root_type") != "") & (family(F.col("a_root_type")) == family(F.col("b_root_type"))), 0.6).otherwise(0.0)
    same = (F.col("a_root_service") != "") & (F.col("a_root_service") == F.col("b_root_service"))
    services = _jaccard(F.col("a_services"), F.col("b_services"))
    keys = F.array_sort(F.array_union(F.map_keys("a_type_histogram"), F.map_keys("b_type_histogram")))
    at = lambda s, k: F.coalesce(F.element_at(F.col(f"{s}_type_histogram"), k), F.lit(0.0))
    dot = lambda x, y: F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + at(x, k) * at(y, k))
    norm = F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))
    cosine = F.when(norm == 0, 0.0).otherwise(dot("a", "b") / norm)
    score = 0.30 * root + 0.28 * F.when(same, F.least(F.lit(1.0), services + 0.25)).otherwise(services) + 0.24 * cosine + 0.10 * _jaccard(F.col("a_locations"), F.col("b_locations")) + 0.08 * (1.0 - F.abs(F.col("a_max_severity") - F.col("b_max_severity")) / 4.0)
    shared = F.array_sort(F.array_intersect("a_services", "b_services"))
    why = [
        F.when(root == 1.0, F.concat(F.lit("same root type ("), "a_root_type", F.lit(")"))).when(root > 0, F.concat(F.lit("same failure family ("), "a_root_type", F.lit(" ~ "), "b_root_type", F.lit(")"))),
        F.when(F.size(shared) > 0, F.concat(F.size(shared).cast("string"), F.lit(" shared services ("), F.concat_ws(", ", F.slice(shared, 1, 4)), F.when(F.size(shared) > 4, "...)").otherwise(")"))),
        F.when(cosine >= 0.7, F.format_string("alike alarm types (cosine %.2f)", half_up(cosine, 2))),
        F.when(same, F.concat(F.lit("same root service ("), "a_root_service", F.lit(")"))),
    ]
    return m.select(F.col("a_incident_id").alias("a"), F.col("b_incident_id").alias("b"), F.col("b_run_id").alias("b_run"), half_up(score, 3).alias("similarity"), F.array_compact(F.array(*why)).alias("reasons"), *more)


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{s}_{c}") for c in _SIDE)).withColumn(f"{s}_family", family(F.col(f"{s}_root_type")))


def compare_signatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, b_run, similarity, reasons) of all pairs of one failure family or one root service; others score 0 and give no row."""
    a, b = _side(left, "a"), _side(right, "b")
    by_family = a.where("a_root_type <> ''").join(b, a["a_family"] == b["b_family"])
    by_service = a.where("a_root_service <> ''").join(b, a["a_root_service"] == b["b_root_service"]).where("NOT (a_root_type <> '' AND a_family = b_family)")
    return _compared(by_family.union(by_service))


# ------------------------------------------------------------------ the k most similar, by bounds

#: Signatures in a block, and pairs of signatures up to which all are compared as rows.
BLOCK, PAIRS = 512, 1_000_000
_PACK = ("root_type", "root_service", "services", "locations", "type_histogram", "max_severity", "incident_id", "run_id", "from")


def _blocks(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with block, one row for each block with the ranges of what it holds).

    A signature stands under its family and under its root service, the two ways to pass the gate. Under each key, rows
    are cut into blocks in order of root type, root service and set sizes, so that a block holds rows that look alike.
    """
    gates = F.array_compact(F.array(F.when(F.col("root_type") != "", F.concat(F.lit("f:"), family(F.col("root_type")))), F.when(F.col("root_service") != "", F.concat(F.lit("s:"), "root_service"))))
    rows = sigs.withColumn("gate", F.explode(gates)).withColumns({"n_services": F.size("services"), "n_locations": F.size("locations")})
    order = ["gate", "root_type", "root_service", "n_services", "n_locations", "max_severity", "incident_id", "run_id", "from"]
    rows = in_order(rows, order, "place").withColumn("block", F.concat_ws("#", "gate", F.expr(f"place div {BLOCK}")))
    ranges = [f(c).alias(f"{n}_{c}") for c in ("root_type", "root_service", "n_services", "n_locations", "max_severity") for n, f in (("lo", F.min), ("hi", F.max))]
    return rows, rows.groupBy("gate", "block").agg(*ranges, F.count("*").alias("n"))


def _bound(a: str, b: str) -> Column:
    """The highest similarity that a pair of these two blocks can have, from the ranges of what they hold."""
    lo, hi = (lambda s, c: F.col(f"{s}.lo_{c}")), (lambda s, c: F.col(f"{s}.hi_{c}"))
    apart = lambda c: F.greatest(lo(a, c) - hi(b, c), lo(b, c) - hi(a, c), F.lit(0))
    meet = lambda c: (lo(a, c) <= hi(b, c)) & (lo(b, c) <= hi(a, c))
    ratio = lambda c: F.when(meet(c), 1.0).otherwise(F.least(hi(a, c), hi(b, c)) / F.greatest(F.lit(1), F.greatest(lo(a, c), lo(b, c))))
    root = F.when(F.col(f"{a}.gate").startswith("s:"), 0.0).when(meet("root_type"), 1.0).otherwise(0.6)
    services = F.when(meet("root_service"), F.least(F.lit(1.0), ratio("n_services") + 0.25)).otherwise(ratio("n_services"))
    return 0.30 * root + 0.28 * services + 0.24 + 0.10 * ratio("n_locations") + 0.08 * (1.0 - apart("max_severity") / 4.0) + 0.001


def _matrix(sets: list, names: list[str]) -> np.ndarray:
    at = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(sets), len(names)))
    for row, s in zip(out, sets, strict=True):
        row[[at[x] for x in s]] = 1
    return out


def _overlap(a: list, b: list) -> np.ndarray:
    names = sorted({x for s in (*a, *b) for x in s})
    x, y = _matrix(a, names), _matrix(b, names)
    both = x @ y.T
    return both / np.maximum(1, x.sum(1)[:, None] + y.sum(1)[None, :] - both)


def _similarities(a: list[dict], b: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, same family) of all pairs of two blocks, in the same steps as _compared, so equal to the last bit."""
    col = lambda rows, c: np.array([r[c] for r in rows], object)
    of = {t: key for key, types, _ in reversed(PATTERNS) for t in types}
    types = [col(x, "root_type") for x in (a, b)]
    families = [np.array([of.get(t, t) for t in x], object) for x in types]
    root = np.where(types[0][:, None] == types[1][None, :], 1.0, np.where(families[0][:, None] == families[1][None, :], 0.6, 0.0)) * (types[0] != "")[:, None]
    own = col(a, "root_service")
    same = (own[:, None] == col(b, "root_service")[None, :]) & (own != "")[:, None]
    services = _overlap([r["services"] for r in a], [r["services"] for r in b])
    dot, norms = np.zeros((len(a), len(b))), [np.zeros(len(a)), np.zeros(len(b))]
    for kind in sorted({k for r in (*a, *b) for k in r["type_histogram"]}):
        x, y = (np.array([r["type_histogram"].get(kind, 0.0) for r in side]) for side in (a, b))
        dot += x[:, None] * y[None, :]
        norms[0] += x * x
        norms[1] += y * y
    norm = np.sqrt(norms[0])[:, None] * np.sqrt(norms[1])[None, :]
    cosine = np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)
    severity = np.abs(np.array([r["max_severity"] for r in a])[:, None] - np.array([r["max_severity"] for r in b])[None, :])
    score = 0.30 * root + 0.28 * np.where(same, np.minimum(1.0, services + 0.25), services) + 0.24 * cosine + 0.10 * _overlap([r["locations"] for r in a], [r["locations"] for r in b]) + 0.08 * (1.0 - severity / 4.0)
    return np.floor(score * 1000.0 + 0.5) / 1000.0, root > 0


def _best_of(k: int):
    """Of one pair of packed blocks: each left signature's k best in the right block, as far as they reach its least."""
    kinds = pa.schema([("a", pa.string()), ("similarity", pa.float64()), ("b", pa.string()), ("from", pa.int32()), ("b_run", pa.string())])

    def run(pair: pa.Table) -> pa.Table:
        row = pair.to_pylist()[0]
        a, b = ([r | {"type_histogram": dict(r["type_histogram"])} for r in row[s]] for s in ("left", "right"))
        score, kin = _similarities(a, b)
        if row["gate"].startswith("s:"):
            score = np.where(kin, -1.0, score)  # pairs of one family meet under it
        out = []
        for i, q in enumerate(a):
            near = np.flatnonzero(score[i] >= q["least"])
            found = [(-score[i, j], b[j]["incident_id"], b[j]["from"], b[j]["run_id"]) for j in near if b[j]["from"] or b[j]["incident_id"] != q["incident_id"]]
            out += [{"a": q["incident_id"], "similarity": -s, "b": i, "from": f, "b_run": r} for s, i, f, r in heapq.nsmallest(k, found)]
        return pa.Table.from_pylist(out, kinds)

    return run


_FOUND = "a string, similarity double, b string, from int, b_run string"


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("similarity").desc(), "b", "from", "b_run"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _bounded(sigs: DataFrame, every: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of every for each of sigs: (a, similarity, b, from, b_run, rank).

    Blocks of both sides are paired under each gate by their bounds. First each block meets the two blocks with the highest
    bounds; from then on a signature's k-th score so far rules out all blocks whose bound lies below it. What moves are
    packed blocks, and rows come out only for candidates that reach a k-th score.
    """
    rows, left = _blocks(sigs.withColumn("from", F.lit(0)))
    others, right = (kept(x) for x in _blocks(every))
    pairs = kept(left.alias("l").join(right.alias("r"), F.col("l.gate") == F.col("r.gate")).select(F.col("l.gate").alias("gate"), F.col("l.block").alias("lb"), F.col("r.block").alias("rb"), _bound("l", "r").alias("bound")))  # blocks of 512 rows
    pairs = pairs.where(F.col("bound") >= least)
    place = F.row_number().over(W.partitionBy("lb").orderBy(F.col("bound").desc(), "rb"))
    pack = lambda df, name, more=(): df.groupBy("block").agg(F.collect_list(F.struct(*_PACK, *more)).alias(name))  # noqa: E731  at most BLOCK rows
    packed = kept(pack(others, "right")).withColumnRenamed("block", "rb")

    def met(chosen: DataFrame, own: DataFrame) -> DataFrame:
        few = chosen.join(pack(own, "left", ("least",)).withColumnRenamed("block", "lb"), "lb").join(packed, "rb")
        return few.select("gate", "lb", "rb", "left", "right").groupBy("lb", "rb").applyInArrow(_best_of(k), _FOUND)

    first = pairs.withColumn("k", place).where("k <= 2").drop("k")
    seen = kept(_top(met(first, rows.withColumn("least", F.lit(least))).distinct(), k))
    kth = seen.where(F.col("rank") == k).select(F.col("a").alias("incident_id"), F.col("similarity").alias("kth"))
    rows = kept(rows.join(kth, "incident_id", "left").withColumn("least", F.coalesce("kth", F.lit(least))).drop("kth"))
    floor = rows.groupBy(F.col("block").alias("lb")).agg(F.min("least").alias("floor"))
    rest = pairs.join(first.select("lb", "rb"), ["lb", "rb"], "left_anti").join(floor, "lb").where(F.col("bound") >= F.col("floor"))
    return _top(seen.drop("rank").union(met(rest, rows)).distinct(), k)


def similar_incidents(sigs: DataFrame, history: DataFrame, k: int = 5, p: Params = DEFAULT) -> DataFrame:
    """(incident_id, match, match_run, similarity, rank, reasons, runs_compared): siblings of the run first on ties, then the archive.

    sigs are one run's, so an incident_id stands once. Up to PAIRS pairs all are compared as rows; beyond that, blocks with
    bounds find the same k (_bounded), and reasons are made for these alone.
    """
    sigs, history = kept(sigs), kept(history)
    n = sigs.count()
    every = sigs.withColumn("from", F.lit(0)).unionByName(history.withColumn("from", F.lit(1)), allowMissingColumns=True)
    if n * (n + history.count()) > PAIRS:
        top = kept(_bounded(sigs, every, k, p.similar_threshold))
        a, b = _side(sigs, "a"), every.select(*(F.col(c).alias(f"b_{c}") for c in _SIDE), "from")
        pairs = top.select(F.col("a").alias("a_incident_id"), F.col("b").alias("b_incident_id"), "from", F.col("b_run").alias("b_run_id"), "rank").join(a, "a_incident_id").join(b, ["b_incident_id", "b_run_id", "from"])
        out = _compared(pairs, "rank")
    else:
        own = compare_signatures(sigs, sigs).where("a <> b").withColumn("from", F.lit(0))
        past = compare_signatures(sigs, history).withColumn("from", F.lit(1))
        out = _top(own.union(past).where(F.col("similarity") >= p.similar_threshold), k)
    runs = history.agg(F.countDistinct("run_id").alias("runs_compared"))
    return out.join(F.broadcast(runs)).select(F.col("a").alias("incident_id"), F.col("b").alias("match"), F.col("b_run").alias("match_run"), "similarity", "rank", "reasons", "runs_compared")  # one row
