"""Queries over the derived alarms, and DuckDB SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.functions import columns as C
from stormsift.operators import actions, baseline, cards, cluster, enrich, graph, merge, noise, patterns, quality_checks, reports, rootcause, sketches
from stormsift.params import CRITICALITY_WEIGHT, DEFAULT, MAINTENANCE_TYPES, MINUTE, OWNERS, PATTERNS, SEVERITY_LABEL, TYPE_PRIOR
from stormsift.plans.storm import documents, held_by_cards, reduce_storm
from stormsift.sources import fixtures, io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, conflicts: bool = False) -> Callable:
    """Registers a query under its function's name; sql follows the CTEs of the derived tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {fixtures.sql(conflicts)}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql}"
        return f

    return register


def _case(key: str, values: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(k, str) else f"WHEN {k} THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


_PRIOR = lambda c: _case(c, TYPE_PRIOR, "0.35")
_IN_MAINT = ", ".join(f"'{t}'" for t in MAINTENANCE_TYPES)

# ------------------------------------------------------------------ inputs, enrichment


def _as_csv(alarms: DataFrame) -> DataFrame:
    """The alarms written as a CSV source has them, and read from it."""
    names = {"veri_merkezi": "datacenter", "kabin": "rack", "ortam": "environment"}
    when = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    path = io.new_folder(alarms.sparkSession)
    alarms.select(*(when if c == "timestamp" else F.col(names.get(c, c)).alias(c) for c in io.ALARM_COLUMNS)).write.option("header", True).csv(path)
    return io.read_alarms_csv(alarms.sparkSession, path)


@_query("""
SELECT 'alarms' AS "check", count(*) = (SELECT count(*) FROM events) AS passed, cast((SELECT count(*) FROM events) AS varchar) AS expected, cast(count(*) AS varchar) AS actual FROM alarms
UNION ALL SELECT 'hosts', count(*) = 56, '56', cast(count(*) AS varchar) FROM hosts UNION ALL SELECT 'dependencies', count(*) = 32, '32', cast(count(*) AS varchar) FROM edges
UNION ALL SELECT 'services', count(*) = 27, '27', cast(count(*) AS varchar) FROM (SELECT service FROM hosts UNION SELECT source FROM edges UNION SELECT target FROM edges)
UNION ALL SELECT 'unique_alarm_id', count(*) = count(DISTINCT alarm_id), cast(count(*) AS varchar), cast(count(DISTINCT alarm_id) AS varchar) FROM alarms
UNION ALL SELECT 'orphan_host', count(*) = 0, '0', cast(count(*) AS varchar) FROM (SELECT DISTINCT host FROM alarms WHERE host NOT IN (SELECT host FROM hosts))
UNION ALL SELECT 'orphan_service', count(*) = 0, '0', cast(count(*) AS varchar) FROM (SELECT DISTINCT service FROM alarms WHERE service NOT IN (SELECT service FROM hosts))
UNION ALL SELECT 'severity_domain', count(*) = 0, '0', cast(count(*) AS varchar) FROM alarms WHERE severity NOT BETWEEN 1 AND 5
UNION ALL SELECT 'observation_window', count(*) = 0, '0', cast(count(*) AS varchar) FROM alarms WHERE us < 1704067200000000 - 300000000 OR us > 1706745600000000 + 300000000
UNION ALL SELECT 'same_ids', count(*) = 0, '0', cast(count(*) AS varchar) FROM (SELECT alarm_id FROM alarms EXCEPT SELECT alarm_id FROM alarms)""", conflicts=True)
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms as derived and, for the comparison of ids, as read from a CSV file of them."""
    a, h, e = fixtures.alarms(spark, sf_dir, True), fixtures.hosts(spark), fixtures.dependencies(spark)
    q = quality_checks
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return q.all_checks(
        q.check_count(a, "alarms", n), q.check_count(h, "hosts", 56), q.check_count(e, "dependencies", 32), q.check_service_catalogue(h, e, 27), q.check_unique(a, "alarm_id"), q.check_orphans(a, h, "host"), q.check_orphans(a, h, "service"), q.check_severity_domain(a),
        q.check_observation_window(a, 1_704_067_200_000_000, 1_706_745_600_000_000), q.check_same_ids(a, _as_csv(a)),
    )


_ENRICHED = """en AS (SELECT a.alarm_id, a.us, a.source_system, a.host, a.service, a.severity, a.alarm_type, a.message, a.week, a.storm, coalesce(h.datacenter, a.datacenter) AS datacenter, coalesce(h.rack, a.rack) AS rack,
  coalesce(h.environment, a.environment) AS environment, coalesce(h.criticality, 'unknown') AS criticality, coalesce(h.service, a.service) AS host_service, h.host IS NOT NULL AS known, a.datacenter AS own_dc, a.rack AS own_rack
  FROM alarms a LEFT JOIN hosts h ON a.host = h.host)"""


@_query(_ENRICHED + " SELECT alarm_id, host, service, datacenter, rack, environment, criticality, host_service FROM en", conflicts=True)
def enrich_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_alarms(fixtures.alarms(spark, sf_dir, True), fixtures.hosts(spark)).select("alarm_id", "host", "service", "datacenter", "rack", "environment", "criticality", "host_service")


@_query(_ENRICHED + """ SELECT 'unknown_hosts' AS kind, count(DISTINCT host) AS n, array_to_string(list_sort(list(DISTINCT host))[1:5], '; ') AS examples FROM en WHERE NOT known
UNION ALL SELECT 'moved_alarms', count(*), '' FROM en WHERE known AND (own_dc <> datacenter OR own_rack <> rack)
UNION ALL SELECT 'service_conflicts', count(DISTINCT host || service), coalesce(array_to_string(list_sort(list(DISTINCT host || ': ' || service || ' != ' || host_service))[1:3], '; '), '') FROM en WHERE known AND service <> host_service""", conflicts=True)
def enrichment_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enrich.enrich_alarms(fixtures.alarms(spark, sf_dir, True), fixtures.hosts(spark))
    return enrich.enrichment_warnings(e).select("kind", "n", F.concat_ws("; ", "examples").alias("examples"))


@_query(f"SELECT alarm_id, datacenter || '/' || rack AS location, {_case('severity', SEVERITY_LABEL, 'cast(severity AS varchar)')} AS severity_label, cast({_PRIOR('alarm_type')} AS double) AS type_prior FROM alarms")
def alarm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.alarms(spark, sf_dir)
    return C.with_type_prior(C.with_severity_label(C.with_location(a))).select("alarm_id", "location", "severity_label", "type_prior")


@_query("SELECT service, count(*) AS n FROM alarms WHERE severity >= 4 GROUP BY service")
def cluster_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.cluster_gate(fixtures.alarms(spark, sf_dir)).groupBy("service").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ baseline


def _model(a: str, x: str) -> str:
    """CTEs of the baseline model over table a, names prefixed by x."""
    b, s = DEFAULT.burst, DEFAULT.slow
    hot = lambda d: f"""SELECT n.service, '{d.kind}' AS kind, n.bin, sum(n.c) AS rolling, sum(n.own) AS cnt, greatest({float(d.min_count)}, baseline * {d.multiplier} + {d.margin}) AS threshold, any_value(baseline) AS baseline
      FROM (SELECT service, bin + d AS bin, cnt AS c, CASE WHEN d = 0 THEN cnt ELSE 0 END AS own FROM {x}series, (SELECT unnest(range({-d.half}, {d.half + 1})) AS d) o) n JOIN {x}base USING (service), {x}span
      WHERE n.bin >= 0 AND n.bin < n_bins GROUP BY n.service, n.bin, baseline HAVING sum(n.c) > greatest({float(d.min_count)}, baseline * {d.multiplier} + {d.margin})"""  # noqa: E731
    return f"""
{x}span AS (SELECT min(us) AS t0, max(us) AS t1, cast((max(us) - min(us)) // {MINUTE} + 2 AS bigint) AS n_bins FROM {a}),
{x}series AS (SELECT service, cast((us - t0) // {MINUTE} AS bigint) AS bin, count(*) AS cnt FROM {a}, {x}span GROUP BY 1, 2),
{x}ranked AS (SELECT service, cnt, row_number() OVER (PARTITION BY service ORDER BY cnt) - 1 + n_bins - count(*) OVER (PARTITION BY service) AS place, n_bins FROM {x}series, {x}span),
{x}base AS (SELECT service, (coalesce(max(CASE WHEN place = (n_bins - 1) // 2 THEN cnt END), 0) + coalesce(max(CASE WHEN place = n_bins // 2 THEN cnt END), 0)) / 2.0 AS baseline FROM {x}ranked GROUP BY service),
{x}hot AS ({hot(b)} UNION ALL {hot(s)}),
{x}cut AS (SELECT *, CASE WHEN bin - lag(bin) OVER w <= {DEFAULT.island_gap} THEN 0 ELSE 1 END AS new FROM {x}hot WINDOW w AS (PARTITION BY service, kind ORDER BY bin)),
{x}isl AS (SELECT *, sum(new) OVER (PARTITION BY service, kind ORDER BY bin) AS window_no FROM {x}cut),
{x}win AS (SELECT service, kind, cast(window_no AS bigint) AS window_no, min(t0 + bin * {MINUTE}) - CASE kind WHEN 'burst' THEN {b.half} ELSE {s.half} END * {MINUTE} AS start_us, max(t0 + (bin + 1) * {MINUTE}) + CASE kind WHEN 'burst' THEN {b.half} ELSE {s.half} END * {MINUTE} AS end_us,
  cast(max(cnt) AS bigint) AS peak_count, any_value(baseline) AS baseline_per_min FROM {x}isl, {x}span GROUP BY service, kind, window_no)"""


_MODEL = _model("alarms", "")


@_query(_MODEL + " SELECT service, bin, cnt, t0, n_bins FROM series, span")
def minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.minute_series(fixtures.alarms(spark, sf_dir))


@_query(_MODEL + " SELECT service, baseline FROM base")
def service_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.service_baseline(baseline.minute_series(fixtures.alarms(spark, sf_dir)))


@_query(_MODEL + " SELECT service, kind, bin, cast(rolling AS bigint) AS rolling, cast(cnt AS bigint) AS cnt, threshold FROM hot")
def hot_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = baseline.minute_series(fixtures.alarms(spark, sf_dir))
    b = baseline.service_baseline(s)
    both = baseline.hot_bins(s, b, DEFAULT.burst, DEFAULT.slow)
    return both.select("service", "kind", "bin", "rolling", "cnt", "threshold")


@_query(_MODEL + " SELECT * FROM win")
def spike_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.spike_windows(fixtures.alarms(spark, sf_dir))


@_query(_MODEL + f" SELECT service, kind, start_us, end_us, peak_count, baseline_per_min, floor((end_us - start_us) / {float(MINUTE)} * 10.0 + 0.5) / 10.0 AS duration_min FROM win")
def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.window_report(baseline.spike_windows(fixtures.alarms(spark, sf_dir)))


@_query(_MODEL + " SELECT (SELECT count(*) FROM base) AS services, (SELECT floor(avg(baseline) * 100.0 + 0.5) / 100.0 FROM base) AS mean_baseline, (SELECT count(*) FROM win WHERE kind = 'burst') AS burst_windows, (SELECT count(*) FROM win WHERE kind = 'slow') AS slow_windows")
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.alarms(spark, sf_dir)
    return baseline.baseline_summary(baseline.service_baseline(baseline.minute_series(a)), baseline.spike_windows(a))


_ACTIVE = "act AS (SELECT a.alarm_id, w.kind, w.window_no, row_number() OVER (PARTITION BY a.alarm_id ORDER BY w.kind, w.start_us, w.window_no) AS k FROM alarms a JOIN win w ON a.service = w.service AND a.us BETWEEN w.start_us AND w.end_us)"


@_query(_MODEL + "," + _ACTIVE + " SELECT alarm_id, kind, window_no, kind IS NOT NULL AS in_spike FROM alarms LEFT JOIN (SELECT * FROM act WHERE k = 1) USING (alarm_id)")
def active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.alarms(spark, sf_dir)
    return baseline.active_window(a, baseline.spike_windows(a))


_NEAR = "near AS (SELECT alarm_id, count(*) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING) - 1 AS neighbours FROM alarms)"


@_query(_NEAR + " SELECT * FROM near")
def host_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.host_neighbours(fixtures.alarms(spark, sf_dir))


@_query(f"m AS (SELECT alarm_type, (us - min(us) OVER ()) / {float(MINUTE)} AS m, (max(us) OVER () - min(us) OVER ()) / {float(MINUTE)} AS span FROM alarms) SELECT alarm_type, count(*) AS n, floor(stddev_pop(m) * 1000.0 + 0.5) / 1000.0 AS std_min, floor(max(span) / sqrt(12) * 1000.0 + 0.5) / 1000.0 AS uniform_std FROM m GROUP BY alarm_type")
def type_time_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.type_time_spread(fixtures.alarms(spark, sf_dir))


_DAY = 24 * 60 * MINUTE


@_query(f"""m AS (SELECT service, us // {MINUTE} AS minute, count(*) AS cnt FROM alarms GROUP BY 1, 2) SELECT service, count(DISTINCT us // {_DAY}) AS days, count(*) AS n, count(DISTINCT host) AS hosts, (SELECT count(*) FROM m WHERE m.service = a.service) AS busy_minutes, true AS median_in_bound FROM alarms a GROUP BY service""")
def sketch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures from daily sketches, merged; services have few hosts, of which both kinds of sketch are exact. For the median,
    whether its rank among the exact counts is within the sketch's error."""
    a = fixtures.alarms(spark, sf_dir)
    daily = io.kept(sketches.daily_sketches(a))
    told = sketches.sketch_report(sketches.merged_sketches(daily))
    counts = a.groupBy("service", F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.count("*").alias("cnt")).join(told.select("service", "median_busy"), "service")
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    ranks = counts.groupBy("service").agg(((share(F.col("cnt") < F.col("median_busy")) <= 0.5 + sketches.RANK_ERROR) & (share(F.col("cnt") <= F.col("median_busy")) >= 0.5 - sketches.RANK_ERROR)).alias("median_in_bound"))
    return told.drop("median_busy").join(ranks, "service")


@_query(f"""d AS (SELECT DISTINCT service, host, us // {_DAY} AS day FROM alarms), x AS (SELECT service, day, lead(day) OVER (PARTITION BY service ORDER BY day) AS next_day FROM (SELECT DISTINCT service, day FROM d))
SELECT service, day, next_day, (SELECT count(*) FROM d p JOIN d q ON p.host = q.host AND p.service = q.service WHERE p.service = x.service AND p.day = x.day AND q.day = x.next_day) AS shared FROM x WHERE next_day IS NOT NULL""")
def shared_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that alarm on two days in a row, from theta sketches (exact below their size)."""
    return sketches.shared_hosts(io.kept(sketches.daily_sketches(fixtures.alarms(spark, sf_dir))))


# ------------------------------------------------------------------ noise

_RULES = _MODEL + "," + _ACTIVE + "," + _NEAR + f""",
ruled AS (SELECT a.*, CASE WHEN alarm_type IN ({_IN_MAINT}) THEN 'maintenance_chatter' WHEN severity <= 2 AND neighbours = 0 THEN 'isolated_low_severity'
  WHEN severity <= 3 AND s.alarm_id IS NULL THEN 'background_baseline' END AS rule FROM alarms a JOIN near USING (alarm_id) LEFT JOIN (SELECT DISTINCT alarm_id FROM act) s ON a.alarm_id = s.alarm_id)"""


def _classified(spark: SparkSession, sf_dir: str, alarms: DataFrame | None = None) -> DataFrame:
    a = fixtures.alarms(spark, sf_dir) if alarms is None else alarms
    return noise.classify_noise(a, io.kept(baseline.spike_windows(a)))


@_query(_RULES + " SELECT alarm_id, rule FROM ruled")
def classify_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("alarm_id", "rule")


@_query(_RULES + " SELECT rule, count(*) AS n FROM ruled WHERE rule IS NOT NULL GROUP BY rule")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.rule_counts(_classified(spark, sf_dir).where("rule IS NOT NULL"))


@_query(_RULES + " SELECT alarm_id, rule, severity FROM ruled WHERE rule IN ('maintenance_chatter', 'background_baseline') AND severity IN (1, 2, 3) AND regexp_matches(message, '(?i)FLAP|disk_w')")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _classified(spark, sf_dir).where("rule IS NOT NULL")
    return noise.audit_search(entries, ("maintenance_chatter", "background_baseline"), (1, 2, 3), "FLAP|disk_w").select("alarm_id", "rule", "severity")


@_query(_RULES + " SELECT GROUPING(rule, service, severity)::INTEGER AS level, rule, service, severity, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM ruled WHERE rule IS NOT NULL GROUP BY GROUPING SETS ((rule, service, severity), (rule, service), (rule, severity), (rule), ())")
def ledger_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.ledger_cube(_classified(spark, sf_dir).where("rule IS NOT NULL"))


# ------------------------------------------------------------------ graph: dependencies between services that raise alarms

_GRAPH = """live AS (SELECT service, count(*) AS n_alarms FROM alarms GROUP BY service),
g AS (SELECT DISTINCT source, target FROM edges WHERE source IN (SELECT service FROM live) AND target IN (SELECT service FROM live)),
und AS (SELECT source AS s, target AS t FROM g UNION SELECT target, source FROM g),
imp0(src, dst, hop) AS (SELECT target, source, 1 FROM g UNION SELECT i.src, g.source, i.hop + 1 FROM imp0 i JOIN g ON i.dst = g.target WHERE i.hop < 3),
imp AS (SELECT src, dst, min(hop) AS hop FROM imp0 WHERE src <> dst GROUP BY src, dst),
up AS (SELECT dst AS src, src AS dst, hop FROM imp),
near0(src, dst, hop) AS (SELECT s, t, 1 FROM und UNION SELECT n.src, u.t, n.hop + 1 FROM near0 n JOIN und u ON n.dst = u.s WHERE n.hop < 3),
nearest AS (SELECT src, dst, min(hop) AS hop FROM near0 WHERE src <> dst GROUP BY src, dst UNION ALL SELECT service, service, 0 FROM live),
raw AS (SELECT service, coalesce(sum(CASE hop WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 END), 0.0) AS raw FROM live LEFT JOIN imp ON service = src GROUP BY service),
central AS (SELECT service, cast(raw AS double) AS raw, least(1.0, raw / greatest(1.0, (SELECT max(raw) FROM raw))) AS centrality FROM raw)"""


def _graph(spark: SparkSession, sf_dir: str, alarms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) among services that raise alarms; nodes carry their alarms.

    Both are kept: they are a row for each service and dependency, and what follows reads them many times.
    """
    live = io.kept((fixtures.alarms(spark, sf_dir) if alarms is None else alarms).groupBy("service").agg(F.count("*").alias("n_alarms")))
    e = fixtures.dependencies(spark)
    for side in ("source", "target"):
        e = e.join(live.select(F.col("service").alias(side)), side, "left_semi")
    return io.kept(e), live


@_query(_GRAPH + " SELECT service, n_alarms, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM g WHERE source = service), '') AS depends_on, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM g WHERE target = service), '') AS dependents FROM live")
def direct_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, live = _graph(spark, sf_dir)
    return graph.direct_neighbours(e, live).join(live, "service").select("service", "n_alarms", F.concat_ws(",", "depends_on").alias("depends_on"), F.concat_ws(",", "dependents").alias("dependents"))


@_query(_GRAPH + " SELECT e.source, e.target, max(e.kind) AS kind, max(e.criticality) AS criticality, count(*) AS listed, any_value(n_alarms) AS n_alarms FROM edges e JOIN g ON g.source = e.source AND g.target = e.target JOIN live ON service = e.target GROUP BY 1, 2")
def edge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, live = _graph(spark, sf_dir)
    return graph.edge_metadata(e).join(live.withColumnRenamed("service", "target"), "target")


@_query(_GRAPH + " SELECT src, dst, hop, n_alarms FROM imp JOIN live ON dst = service")
def impact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, live = _graph(spark, sf_dir)
    return graph.impact_set(e).join(live.withColumnRenamed("service", "dst"), "dst")


@_query(_GRAPH + " SELECT src, dst, hop, n_alarms FROM up JOIN live ON dst = service")
def upstream_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, live = _graph(spark, sf_dir)
    return graph.upstream_set(e).join(live.withColumnRenamed("service", "dst"), "dst")


@_query(_GRAPH + " SELECT src, dst, hop, n_alarms FROM nearest JOIN live ON dst = service")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, live = _graph(spark, sf_dir)
    return graph.hop_distance(e, live).join(live.withColumnRenamed("service", "dst"), "dst")


@_query(_GRAPH + """ SELECT src AS a, dst AS b, hop, CASE WHEN src = dst THEN 'same service' WHEN EXISTS (SELECT 1 FROM g WHERE source = src AND target = dst) THEN src || ' depends on ' || dst
  WHEN EXISTS (SELECT 1 FROM g WHERE source = dst AND target = src) THEN dst || ' depends on ' || src ELSE cast(hop AS varchar) || ' hops apart' END AS reason FROM nearest WHERE hop <= 2""")
def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_pairs(*_graph(spark, sf_dir))


@_query(_GRAPH + " SELECT * FROM central")
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(*_graph(spark, sf_dir))


@_query(_GRAPH + " SELECT * FROM central ORDER BY centrality DESC, service LIMIT 15")
def top_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_central(graph.centrality(*_graph(spark, sf_dir)))


@_query(_GRAPH + """, dd AS (SELECT service, list_sort(list(source)) AS d FROM live JOIN g ON target = service GROUP BY service)
SELECT service, coalesce(len(d), 0)::INTEGER AS n_direct, (SELECT count(*) FROM imp WHERE src = service) AS n_total, CASE WHEN d IS NULL THEN service || ' is a leaf: nothing depends on it' ELSE cast(len(d) AS varchar) || ' services depend on ' || service || ' directly (' || array_to_string(d[1:3], ', ') || '), '
  || cast((SELECT count(*) FROM imp WHERE src = service) AS varchar) || ' within 3 hops' END AS text FROM live LEFT JOIN dd USING (service)""")
def describe_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.describe_service(*_graph(spark, sf_dir)).select("service", "n_direct", "n_total", "text")


# ------------------------------------------------------------------ clusters and incidents of the real chain (order-dependent: rows only)


def _storm(spark: SparkSession, sf_dir: str):
    return reduce_storm(fixtures.alarms(spark, sf_dir), fixtures.hosts(spark), fixtures.dependencies(spark))


@_query()
def find_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storm(spark, sf_dir).clusters


@_query()
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, h = fixtures.dependencies(spark), fixtures.hosts(spark)
    return merge.candidate_links(_storm(spark, sf_dir).clusters, graph.related_pairs(e, graph.graph_nodes(e, h)))


@_query()
def merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storm(spark, sf_dir).reasons


@_query()
def sweep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, h = fixtures.dependencies(spark), fixtures.hosts(spark)
    return merge.sweep_merge(_storm(spark, sf_dir).clusters, graph.related_pairs(e, graph.graph_nodes(e, h)), [(60, 10), (40, 8), (30, 6), (25, 5)])


@_query()
def ranked_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storm(spark, sf_dir).ranked


@_query()
def storm_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storm(spark, sf_dir).ledger.select("alarm_id", "rule", "reason")


@_query(" SELECT count(*) AS expected, true AS no_loss, true AS ids_unique FROM alarms")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _storm(spark, sf_dir)
    return reports.integrity(s.alarms, held_by_cards(s), s.ledger).select("expected", "no_loss", "ids_unique")


@_query()
def storm_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(_storm(spark, sf_dir), fixtures.dependencies(spark))


# ------------------------------------------------------------------ after the merge: incidents by formula, one per week and service

_MEMBERS = """a AS (SELECT x.*, coalesce(h.criticality, 'unknown') AS criticality FROM alarms x LEFT JOIN hosts h USING (host)),
mem AS (SELECT alarm_id, 'INC-' || cast(week AS varchar) || '-' || service AS incident_id FROM alarms WHERE storm AND severity >= 4),
ma AS (SELECT a.*, incident_id FROM a JOIN mem USING (alarm_id)),
inc AS (SELECT incident_id, count(*) AS alarm_count, count(DISTINCT service) AS n_services, count(DISTINCT host) AS n_hosts, count(DISTINCT datacenter || '/' || rack) AS n_locations, min(us) AS start_us, max(us) AS end_us, max(severity) AS max_severity FROM ma GROUP BY incident_id)"""
_WEEKLY = _MEMBERS.replace("'INC-' || cast(week AS varchar) || '-' || service", "'INC-' || cast(week AS varchar)")
_SCORES = f"""sh AS (SELECT incident_id, service, count(*) / sum(count(*)) OVER (PARTITION BY incident_id) AS share FROM ma GROUP BY 1, 2),
p AS (SELECT ma.*, floor(35.0 * CASE WHEN end_us <= start_us THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - cast(us - start_us AS double) / (end_us - start_us))) END * 100.0 + 0.5) / 100.0 AS temporal,
  floor(25.0 * coalesce(c.centrality, 0.0) * 100.0 + 0.5) / 100.0 AS central, floor(25.0 * cast({_PRIOR("alarm_type")} AS double) * 100.0 + 0.5) / 100.0 AS prior,
  floor(10.0 * ((severity - 1) / 4.0) * 100.0 + 0.5) / 100.0 AS severe, floor(5.0 * cast(share AS double) * 100.0 + 0.5) / 100.0 AS blast
  FROM ma JOIN inc USING (incident_id) JOIN sh USING (incident_id, service) LEFT JOIN central c USING (service)),
sc AS (SELECT *, floor((temporal + central + prior + severe + blast) * 100.0 + 0.5) / 100.0 AS total FROM p),
rk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY total DESC, us, alarm_id) AS rank FROM sc),
rt AS (SELECT * FROM rk WHERE rank = 1),
ct AS (SELECT k.*, row_number() OVER (PARTITION BY k.incident_id ORDER BY CASE WHEN k.service = rt.service THEN 1 ELSE 0 END, k.rank) AS place FROM rk k JOIN rt ON k.incident_id = rt.incident_id WHERE k.rank > 1)"""


def _members(spark: SparkSession, sf_dir: str, weekly: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, alarms); the alarms are kept, as each step reads them again."""
    a = io.kept(enrich.enrich_alarms(fixtures.alarms(spark, sf_dir), fixtures.hosts(spark)))
    parts = [F.lit("INC"), F.col("week").cast("string"), *([] if weekly else [F.col("service")])]
    return a.where("storm AND severity >= 4").select("alarm_id", F.concat_ws("-", *parts).alias("incident_id")), a


def _scored(spark: SparkSession, sf_dir: str, weekly: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    m, a = _members(spark, sf_dir, weekly)
    return rootcause.score_alarms(m, a, graph.centrality(*_graph(spark, sf_dir, a))), m, a


@_query(_WEEKLY + " SELECT incident_id, alarm_count, n_services::INTEGER AS n_services, n_hosts::INTEGER AS n_hosts, n_locations::INTEGER AS n_locations, start_us, end_us, max_severity, floor((end_us - start_us) / 60000000.0 * 10.0 + 0.5) / 10.0 AS duration_min FROM inc")
def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = merge.incident_summary(*_members(spark, sf_dir, True))
    return s.select("incident_id", "alarm_count", *(F.size(c).alias(f"n_{c}") for c in ("services", "hosts", "locations")), "start_us", "end_us", "max_severity", "duration_min")


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + " SELECT incident_id, service, cast(share AS double) AS share FROM sh")
def service_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rootcause.service_shares(*_members(spark, sf_dir, True))


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + " SELECT incident_id, alarm_id, temporal, central, prior, severe, blast, total FROM sc")
def score_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True)[0].select("incident_id", "alarm_id", "temporal", "central", "prior", "severe", "blast", "total")


_ROOTS = " SELECT rt.incident_id, rt.alarm_id AS root_alarm_id, rt.service AS root_service, rt.alarm_type AS root_type, rt.total AS root_total, ct.alarm_id AS counter_alarm_id, ct.service AS counter_service, ct.total AS counter_total, floor((rt.total - ct.total) * 100.0 + 0.5) / 100.0 AS delta FROM rt LEFT JOIN (SELECT * FROM ct WHERE place = 1) ct ON rt.incident_id = ct.incident_id"


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + _ROOTS)
def root_and_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rootcause.root_and_counter(_scored(spark, sf_dir, True)[0])


_OWNER = _case("root_type", {t: who for who, types in OWNERS.items() for t in types}, "'platform-oncall'")
_FAMILY = _case("root_type", {t: key for key, types, _ in reversed(PATTERNS) for t in types}, "root_type")
_STEP = f"'open the runbook of ' || {_FAMILY}"


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + f" SELECT rt.incident_id, rt.service || ': ' || {_STEP.replace('root_type', 'rt.alarm_type')} || ' (' || cast(n_services AS varchar) || ' services, ' || cast(alarm_count AS varchar) || ' alarms)' AS action, {_OWNER.replace('root_type', 'rt.alarm_type')} AS owner FROM rt JOIN inc ON inc.incident_id = rt.incident_id")
def suggested_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, a = _scored(spark, sf_dir, True)
    return rootcause.actions_for(rootcause.root_and_counter(s), merge.incident_summary(m, a)).select("incident_id", "action", "owner")


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + """ SELECT rt.incident_id, (SELECT count(*) FROM ma WHERE ma.incident_id = rt.incident_id AND ma.us < rt.us) AS earlier, floor((rt.us - inc.start_us) / 60000000.0 * 10.0 + 0.5) / 10.0 AS offset_min,
  (SELECT count(*) FROM imp WHERE hop <= 2 AND src = rt.service) AS expected, (SELECT count(*) FROM imp WHERE hop <= 2 AND src = rt.service AND dst IN (SELECT service FROM ma WHERE ma.incident_id = rt.incident_id)) AS hit FROM rt JOIN inc USING (incident_id)""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, a = _scored(spark, sf_dir, True)
    e = rootcause.evidence(m, a, rootcause.root_and_counter(s), graph.impact_set(_graph(spark, sf_dir)[0]))
    return e.select("incident_id", "earlier", "offset_min", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("hit", F.lit(0)).alias("hit"))


_UP = "EXISTS (SELECT 1 FROM up WHERE src = rt.service AND dst = c.service AND hop <= 2)"


@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + f""" SELECT rt.incident_id, 'At ' || strftime(make_timestamp(rt.us), '%H:%M:%S') || ' ' || rt.service || ' on ' || rt.host || ' raised ''' || rt.alarm_type || '''. '
  || CASE WHEN n_services > 1 THEN cast(n_services - 1 AS varchar) || ' other services raised ' || cast(alarm_count - 1 AS varchar) || ' alarms after it; the incident took ' ELSE 'It stayed within the service: ' || cast(alarm_count AS varchar) || ' alarms in ' END
  || cast(cast(floor(floor((inc.end_us - inc.start_us) / 60000000.0 * 10.0 + 0.5) / 10.0 + 0.5) AS bigint) AS varchar) || ' minutes.' AS explanation,
  c.service || ' ''' || c.alarm_type || ''' is ' || printf('%.1f', floor((rt.total - c.total) * 10.0 + 0.5) / 10.0) || ' points behind. '
  || CASE WHEN {_UP} THEN rt.service || ' depends on ' || c.service || ', so the root may be a symptom.' WHEN c.us < rt.us THEN c.service || ' came first.' ELSE c.service || ' stands on a branch of its own: two failures may overlap.' END
  || ' Check ' || c.host || ' around ' || strftime(make_timestamp(c.us), '%H:%M') || '.' AS counter_reason
  FROM rt JOIN inc ON inc.incident_id = rt.incident_id LEFT JOIN (SELECT * FROM ct WHERE place = 1) c ON c.incident_id = rt.incident_id""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, a = _scored(spark, sf_dir, True)
    return rootcause.explanations(rootcause.root_and_counter(s), merge.incident_summary(m, a), graph.upstream_set(_graph(spark, sf_dir)[0]), a)


_LINKS = f"""rel AS (SELECT src AS a, dst AS b, CASE WHEN src = dst THEN 'same service' WHEN EXISTS (SELECT 1 FROM g WHERE source = src AND target = dst) THEN src || ' depends on ' || dst
  WHEN EXISTS (SELECT 1 FROM g WHERE source = dst AND target = src) THEN dst || ' depends on ' || src ELSE cast(hop AS varchar) || ' hops apart' END AS how FROM nearest WHERE hop <= 2),
cl AS (SELECT incident_id AS cid, service, min(us) AS s, list_sort(list(DISTINCT datacenter || '/' || rack)) AS places FROM ma GROUP BY incident_id, service),
lk AS (SELECT x.cid AS a, y.cid AS b, x.service AS xs, y.service AS ys, y.s - x.s AS gap_us, how, list_sort(list_intersect(x.places, y.places)) AS shared
  FROM cl x JOIN cl y ON (x.s < y.s OR x.s = y.s AND (x.service < y.service OR x.service = y.service AND x.cid < y.cid)) AND y.s - x.s <= {DEFAULT.onset_gap * MINUTE} LEFT JOIN rel ON rel.a = x.service AND rel.b = y.service)"""


@_query(_MEMBERS + "," + _GRAPH + "," + _LINKS + f""" SELECT a, b, gap_us, CASE WHEN how IS NOT NULL THEN 'dependency' ELSE 'locality' END AS link_kind,
  xs || ' and ' || ys || ' began to fail ' || CASE WHEN gap_us < {MINUTE} THEN 'at the same time' ELSE cast(cast(round(gap_us / {float(MINUTE)}) AS int) AS varchar) || ' min apart' END
  || CASE WHEN how IS NOT NULL THEN '; ' || how || ' (dependency)' ELSE ' and share ' || array_to_string(shared, ', ') || ' (locality)' END AS reason
  FROM lk WHERE how IS NOT NULL OR gap_us <= {DEFAULT.locality_gap * MINUTE} AND len(shared) > 0""")
def formula_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate links where each week's failing services are the clusters."""
    m, a = _members(spark, sf_dir)
    formed = m.select("alarm_id", F.col("incident_id").alias("cluster_id"), F.lit("burst").alias("window_kind"))
    return merge.candidate_links(cluster.cluster_summary(formed, a), graph.related_pairs(*_graph(spark, sf_dir)))


_PAT = "pat(key, roots, symptoms) AS (VALUES " + ", ".join(f"('{k}', [{', '.join(repr(x) for x in r)}], [{', '.join(repr(x) for x in s)}])" for k, r, s in PATTERNS) + ")"
_MATCHED = """pm AS (SELECT rt.incident_id, key, len(symptoms) AS of, (SELECT count(*) FROM ma WHERE ma.incident_id = rt.incident_id AND list_contains(symptoms, ma.alarm_type)) AS hit,
  (SELECT count(DISTINCT ma.alarm_type) FROM ma WHERE ma.incident_id = rt.incident_id AND list_contains(symptoms, ma.alarm_type)) AS kinds, inc.alarm_count FROM rt JOIN inc ON inc.incident_id = rt.incident_id JOIN pat ON list_contains(roots, rt.alarm_type)),
ps AS (SELECT *, cast(0.55 AS double) + cast(0.30 AS double) * (cast(hit AS double) / alarm_count) + cast(0.15 AS double) * (cast(kinds AS double) / of) AS s FROM pm)"""
_SLOTS = "sl AS (SELECT *, CASE WHEN rank <= CASE WHEN (SELECT count(*) FROM rd) > 15 THEN 14 ELSE 15 END THEN 'card' ELSE 'bucket' END AS slot FROM rd)"
_CRIT = _case("criticality", CRITICALITY_WEIGHT, "0.5")
_RANKED = f"""cr AS (SELECT incident_id, avg(cast({_CRIT} AS double)) AS crit FROM ma GROUP BY incident_id),
gt AS (SELECT inc.*, crit, rt.alarm_type AS root_type, alarm_count >= 10 AND (n_services >= 2 OR max_severity >= 5 OR cast({_PRIOR("rt.alarm_type")} AS double) >= 0.5) AS passes FROM inc JOIN cr USING (incident_id) JOIN rt ON rt.incident_id = inc.incident_id),
mx AS (SELECT greatest(1.0, max(n_services + 0.25 * n_hosts)) AS mb, greatest(1, max(alarm_count)) AS mv FROM gt WHERE passes),
pt AS (SELECT *, floor(cast(0.40 AS double) * ((max_severity - 1) / 4.0) * 10000.0 + 0.5) / 10000.0 AS p_severity, floor(cast(0.35 AS double) * least(1.0, cast(n_services + 0.25 * n_hosts AS double) / mb) * 10000.0 + 0.5) / 10000.0 AS p_breadth,
  floor(cast(0.15 AS double) * least(1.0, cast(alarm_count AS double) / mv) * 10000.0 + 0.5) / 10000.0 AS p_volume, floor(cast(0.10 AS double) * crit * 10000.0 + 0.5) / 10000.0 AS p_criticality FROM gt, mx WHERE passes),
sd AS (SELECT *, floor((p_severity + p_breadth + p_volume + p_criticality) * 10000.0 + 0.5) / 10000.0 AS score FROM pt),
rd AS (SELECT *, row_number() OVER (ORDER BY score DESC, start_us, incident_id) AS rank, CASE WHEN score >= 0.70 OR (max_severity >= 5 AND n_services >= 5) THEN 'P1' WHEN score >= 0.40 OR max_severity >= 4 THEN 'P2' ELSE 'P3' END AS label FROM sd)"""
_CHAIN = _MEMBERS + "," + _GRAPH + "," + _SCORES + "," + _RANKED


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(capped, gated, members, alarms). Members meet their alarms once; that and the gated incidents are kept, as each is read several times."""
    m, a = _members(spark, sf_dir)
    met = io.kept(C.with_alarms(m, a, "us", "service", "host", "severity", "alarm_type", "datacenter", "rack", "criticality"))
    s = rootcause.score_alarms(met, a, graph.centrality(*_graph(spark, sf_dir, a)))
    gated = io.kept(cards.with_gate(merge.incident_summary(met, a), rootcause.root_and_counter(s)))
    return cards.cap_cards(cards.prioritise(gated, met, a)), gated, m, a


@_query(_CHAIN + " SELECT incident_id, passes FROM gt")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[1].select("incident_id", "passes")


@_query(_CHAIN + " SELECT incident_id, p_severity, p_breadth, p_volume, p_criticality, score, rank::INTEGER AS rank, label FROM rd")
def prioritise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[0].select("incident_id", "p_severity", "p_breadth", "p_volume", "p_criticality", "score", "rank", "label")


@_query(_CHAIN + " SELECT incident_id, CASE WHEN rank <= CASE WHEN (SELECT count(*) FROM rd) > 15 THEN 14 ELSE 15 END THEN 'card' ELSE 'bucket' END AS slot FROM rd")
def cap_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[0].select("incident_id", "slot")


@_query(_CHAIN + "," + _SLOTS + "," + _PAT + "," + _MATCHED + ", s AS (SELECT CASE slot WHEN 'card' THEN 1 ELSE 0 END AS c FROM sl) SELECT (SELECT count(*) FROM sl JOIN ps ON ps.incident_id = sl.incident_id WHERE slot = 'card' AND s >= 0.45) AS pattern_matches, (SELECT count(DISTINCT sl.incident_id) FROM sl JOIN ps ON ps.incident_id = sl.incident_id WHERE slot = 'card' AND s >= 0.45) AS known_cards, (SELECT count(*) FROM alarms WHERE severity >= 4 AND NOT storm) AS residual, (SELECT count(*) FROM gt) AS detected, (SELECT count(*) FROM gt WHERE passes) AS passing, (SELECT count(*) FROM gt WHERE NOT passes) AS below, (SELECT count(*) FROM s WHERE c = 1) AS own_slot, (SELECT count(*) FROM s WHERE c = 0) AS rolled_up, (SELECT count(*) FROM s WHERE c = 1) + CASE WHEN (SELECT count(*) FROM s WHERE c = 0) > 0 THEN 1 ELSE 0 END AS total_cards")
def card_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual are severe alarms outside the storms."""
    capped, gated, m, a = _ranked(spark, sf_dir)
    known = patterns.match_patterns(m, a, rootcause.root_and_counter(_scored(spark, sf_dir)[0]), patterns.known_patterns(spark))
    return cards.card_stats(gated, capped, known, a.where("severity >= 4 AND NOT storm"))


_TEXTS = """CASE rule WHEN 'maintenance_chatter' THEN 'maintenance type ' || alarm_type WHEN 'isolated_low_severity' THEN 'severity ' || cast(severity AS varchar) || ' and no other alarm on ' || host || ' within 30 min'
  WHEN 'background_baseline' THEN 'severity ' || cast(severity AS varchar) || ' outside every spike window of ' || service WHEN 'background_in_window' THEN 'below the severity that joins clusters'
  WHEN 'unclustered_residual' THEN 'in no dense enough cluster' ELSE 'its incident failed the quality gate' END"""


_LEDGER = _RULES + "," + _CHAIN.replace("a AS (SELECT x.*", "a2 AS (SELECT x.*").replace("SELECT a.*, incident_id FROM a JOIN", "SELECT a2.*, incident_id FROM a2 JOIN") + f""", lg AS (SELECT r.alarm_id, r.alarm_type, r.severity, r.host, r.service,
  coalesce(r.rule, CASE WHEN r.severity < 4 THEN 'background_in_window' WHEN mem.incident_id IS NULL THEN 'unclustered_residual' WHEN NOT gt.passes THEN 'low_confidence_cluster' END) AS rule
  FROM ruled r LEFT JOIN mem ON mem.alarm_id = r.alarm_id LEFT JOIN gt ON gt.incident_id = mem.incident_id)"""


@_query(_LEDGER + f""" SELECT alarm_id, rule, {_TEXTS} AS reason FROM lg WHERE rule IS NOT NULL""")
def formula_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger where each week's failing services are the incidents."""
    _, gated, m, a = _ranked(spark, sf_dir)
    carded = m.join(gated.where("passes").select("incident_id"), "incident_id", "left_semi")
    return noise.ledger(_classified(spark, sf_dir, a), m, carded).select("alarm_id", "rule", "reason")


@_query(_LEDGER + "," + _SLOTS + """, t AS (SELECT (SELECT count(*) FROM mem JOIN sl ON sl.incident_id = mem.incident_id) AS in_cards, (SELECT count(*) FROM lg WHERE rule IS NOT NULL) AS in_ledger, (SELECT count(*) FROM (SELECT alarm_id FROM mem JOIN sl ON sl.incident_id = mem.incident_id UNION SELECT alarm_id FROM lg WHERE rule IS NOT NULL)) AS distinct_ids, (SELECT count(*) FROM alarms) AS expected)
SELECT *, in_cards + in_ledger = expected AS no_loss, distinct_ids = expected AS ids_unique FROM t""")
def formula_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and ledger where each week's failing services are the incidents."""
    capped, gated, m, a = _ranked(spark, sf_dir)
    held = cards.membership(io.kept(capped), m)
    entries = noise.ledger(_classified(spark, sf_dir, a), m, m.join(gated.where("passes").select("incident_id"), "incident_id", "left_semi"))
    return reports.integrity(a, held, entries)


_CARD = "CASE WHEN slot = 'card' THEN 'INC-' || lpad(cast(sl.rank AS varchar), 3, '0') ELSE 'INC-UNCLUSTERED' END"


def _card_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Membership and facts of the cards, as written and read again."""
    capped, _, m, a = _ranked(spark, sf_dir)
    held = io.kept(cards.membership(io.kept(capped), m))
    path = io.new_folder(spark)
    io.write_outputs({"membership": held, "facts": cards.card_facts(held, a)}, path)
    return io.read_outputs(spark, path, "membership", "facts")


@_query(_CHAIN + "," + _SLOTS + f" SELECT {_CARD} AS card_id, sl.incident_id, alarm_id FROM sl JOIN mem ON mem.incident_id = sl.incident_id")
def card_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card_tables(spark, sf_dir)["membership"].select("card_id", "incident_id", "alarm_id")


@_query(_CHAIN + "," + _SLOTS + f""", hm AS (SELECT {_CARD} AS card_id, ma.* FROM sl JOIN ma ON ma.incident_id = sl.incident_id), hr AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us, alarm_id) AS k FROM hm),
hy AS (SELECT card_id, string_agg(alarm_type || ':' || cast(n AS varchar), ',' ORDER BY alarm_type) AS types FROM (SELECT card_id, alarm_type, count(*) AS n FROM hm GROUP BY 1, 2) GROUP BY card_id)
SELECT card_id, count(*) AS alarm_count, string_agg(DISTINCT service, ',' ORDER BY service) AS services, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems, max(severity) AS max_severity, min(us) AS start_us, max(us) AS end_us, any_value(types) AS types,
  sha256(string_agg(alarm_id, ',' ORDER BY k) FILTER (WHERE k <= {cards.HEAD})) AS head FROM hr JOIN hy USING (card_id) GROUP BY card_id""")
def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each card as written and read again; head is a digest of the first alarms' ids."""
    f = _card_tables(spark, sf_dir)["facts"]
    types = F.array_join(F.transform(F.array_sort(F.map_entries("alarm_type_histogram")), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return f.select("card_id", "alarm_count", F.array_join("services", ",").alias("services"), F.array_join("source_systems", ",").alias("source_systems"), "max_severity", "start_us", "end_us", types.alias("types"), F.sha2(F.array_join("alarm_ids", ","), 256).alias("head"))


_EVENT = "array_to_string(list_transform(string_split(replace(root_type, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


@_query(_CHAIN + "," + _SLOTS + f""", pl AS (SELECT incident_id, min(datacenter) AS dc, min(rack) AS rack FROM ma GROUP BY incident_id HAVING count(DISTINCT datacenter || '/' || rack) = 1),
cd AS (SELECT 'INC-' || lpad(cast(sl.rank AS varchar), 3, '0') AS card_id, sl.start_us, sl.n_services, dc, pl.rack, rt.service AS root_service, root_type, {_EVENT} AS event FROM sl JOIN rt ON rt.incident_id = sl.incident_id LEFT JOIN pl ON pl.incident_id = sl.incident_id WHERE slot = 'card'),
st AS (SELECT *, CASE WHEN dc IS NOT NULL AND root_type IN ('network_down', 'pkt_loss', 'network_flap') THEN upper(dc) || ' ' || replace(rack, 'rack-', 'Rack-') || ' ' || event ELSE root_service || ' ' || event END AS short FROM cd)
SELECT card_id, root_service || ': ' || event || ' - ' || CASE WHEN n_services > 1 THEN 'spread to ' || cast(n_services AS varchar) || ' services' ELSE 'within one service' END AS title,
  CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN short || ' (' || strftime(make_timestamp(start_us), '%H:%M') || ')' ELSE short END AS display_title FROM st""")
def card_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.titles(_ranked(spark, sf_dir)[0])


@_query(_CHAIN + "," + _SLOTS + """, ov AS (SELECT sl.*, rt.alarm_id AS root_alarm_id FROM sl JOIN rt ON rt.incident_id = sl.incident_id WHERE slot = 'bucket'),
ot AS (SELECT count(*) AS alarm_count, string_agg(DISTINCT service, '|' ORDER BY service) AS services, string_agg(DISTINCT host, '|' ORDER BY host) AS hosts, string_agg(DISTINCT datacenter || '/' || rack, '|' ORDER BY datacenter || '/' || rack) AS locations, max(severity) AS max_severity, min(us) AS start_us, max(us) AS end_us FROM ma WHERE incident_id IN (SELECT incident_id FROM ov))
SELECT 'INC-UNCLUSTERED' AS card_id, 'P4' AS label, ot.*, (SELECT string_agg(cast(rank AS varchar) || ':' || incident_id || ':' || cast(alarm_count AS varchar) || ':' || root_alarm_id, '|' ORDER BY rank) FROM ov) AS rolled_up, (SELECT cast(count(*) AS varchar) FROM ov) || ' incidents ranked below the cards' AS reasons FROM ot WHERE alarm_count > 0""")
def bucket_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped, _, m, a = _ranked(spark, sf_dir)
    b = cards.bucket_card(io.kept(capped), m, a)
    rolled = F.transform("rolled_up", lambda x: F.concat_ws(":", x["rank"], x["incident_id"], x["alarm_count"], x["root_alarm_id"]))
    joined = [F.array_join(c, "|").alias(c) for c in ("services", "hosts", "locations", "reasons")]
    return b.select("card_id", "label", "alarm_count", *joined, "max_severity", "start_us", "end_us", F.array_join(rolled, "|").alias("rolled_up"))




@_query(_WEEKLY + "," + _GRAPH + "," + _SCORES + "," + _PAT + "," + _MATCHED + """ SELECT incident_id, key AS pattern_key, floor(s * 1000.0 + 0.5) / 1000.0 AS confidence, floor(cast(hit AS double) / alarm_count * 1000.0 + 0.5) / 1000.0 AS symptom_share FROM ps WHERE s >= 0.45""")
def match_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, a = _scored(spark, sf_dir, True)
    return patterns.match_patterns(m, a, rootcause.root_and_counter(s), patterns.known_patterns(spark)).select("incident_id", "pattern_key", "confidence", "symptom_share")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, a = _scored(spark, sf_dir)
    return patterns.signatures(merge.incident_summary(m, a), m, a, rootcause.root_and_counter(s), "run-2")


_WHY = """array_to_string(list_filter([CASE WHEN root = 1.0 THEN 'same root type (' || xt || ')' WHEN root > 0 THEN 'same failure family (' || xt || ' ~ ' || yt || ')' END,
  CASE WHEN len(shared) > 0 THEN cast(len(shared) AS varchar) || ' shared services (' || array_to_string(shared[1:4], ', ') || CASE WHEN len(shared) > 4 THEN '...)' ELSE ')' END END,
  CASE WHEN cosine >= 0.7::DOUBLE THEN 'alike alarm types (cosine ' || printf('%.2f', floor(cosine * 100.0 + 0.5) / 100.0) || ')' END, CASE WHEN same THEN 'same root service (' || xs || ')' END], lambda x: x IS NOT NULL), '; ')"""
_SIGS = f"""sv AS (SELECT incident_id, list_sort(list(DISTINCT service)) AS services, list_sort(list(DISTINCT datacenter || '/' || rack)) AS locations FROM ma GROUP BY incident_id),
hk AS (SELECT incident_id, alarm_type, floor(cast(count(*) AS double) / cast(sum(count(*)) OVER (PARTITION BY incident_id) AS double) * 10000.0 + 0.5) / 10000.0 AS share FROM ma GROUP BY 1, 2),
sg AS (SELECT *, {_FAMILY} AS family FROM (SELECT inc.*, services, locations, rt.alarm_type AS root_type, rt.service AS root_service FROM inc JOIN sv ON sv.incident_id = inc.incident_id JOIN rt ON rt.incident_id = inc.incident_id)),
nm AS (SELECT incident_id, sqrt(sum(share * share)) AS norm FROM hk GROUP BY incident_id),
dt AS (SELECT x.incident_id AS a, y.incident_id AS b, sum(x.share * y.share) AS dot FROM hk x JOIN hk y USING (alarm_type) GROUP BY 1, 2),
pa AS (SELECT x.incident_id AS a, y.incident_id AS b, x.root_type AS xt, y.root_type AS yt, x.root_service AS xs, list_sort(list_intersect(x.services, y.services)) AS shared, CASE WHEN x.root_type = y.root_type THEN 1.0 WHEN x.family = y.family THEN 0.6 ELSE 0.0 END::DOUBLE AS root, x.root_service = y.root_service AS same,
  len(list_intersect(x.services, y.services))::DOUBLE / len(list_distinct(list_concat(x.services, y.services))) AS js, len(list_intersect(x.locations, y.locations))::DOUBLE / len(list_distinct(list_concat(x.locations, y.locations))) AS jl,
  coalesce(dot, 0.0)::DOUBLE / (n.norm * o.norm) AS cosine, abs(x.max_severity - y.max_severity)::DOUBLE AS gap
  FROM sg x JOIN sg y ON x.family = y.family OR x.root_service = y.root_service JOIN nm n ON n.incident_id = x.incident_id JOIN nm o ON o.incident_id = y.incident_id LEFT JOIN dt ON dt.a = x.incident_id AND dt.b = y.incident_id),
sm AS (SELECT a, b, {_WHY} AS reasons, floor((0.30::DOUBLE * root + 0.28::DOUBLE * CASE WHEN same THEN least(1.0::DOUBLE, js + 0.25::DOUBLE) ELSE js END + 0.24::DOUBLE * cosine + 0.10::DOUBLE * jl + 0.08::DOUBLE * (1.0::DOUBLE - gap / 4.0::DOUBLE)) * 1000.0 + 0.5) / 1000.0 AS similarity FROM pa)"""
_ALIKE = _MEMBERS + "," + _GRAPH + "," + _SCORES + "," + _SIGS


@_query(_ALIKE + """ SELECT incident_id, 'run-2' AS run_id, start_us AS occurred_us, root_type, root_service, array_to_string(services, '|') AS services, array_to_string(locations, '|') AS locations,
  (SELECT string_agg(alarm_type || ':' || cast(cast(round(share * 10000.0) AS bigint) AS varchar), '|' ORDER BY alarm_type) FROM hk WHERE hk.incident_id = sg.incident_id) AS type_histogram,
  max_severity, alarm_count, floor((end_us - start_us) / 60000000.0 * 10.0 + 0.5) / 10.0 AS duration_min FROM sg""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.map_entries("type_histogram")), lambda x: F.concat_ws(":", x["key"], F.round(x["value"] * 10000.0).cast("long")))
    joined = {c: F.array_join(c, "|") for c in ("services", "locations")} | {"type_histogram": F.array_join(parts, "|")}
    return _signatures(spark, sf_dir).withColumns(joined)


@_query(_ALIKE + " SELECT a, b, 'run-2' AS b_run, similarity, reasons FROM sm WHERE a < b")
def compare_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = io.kept(_signatures(spark, sf_dir))
    return patterns.compare_signatures(s, s).where("a < b").withColumn("reasons", F.array_join("reasons", "; "))


@_query(_ALIKE + """, ev AS (SELECT a, b, 'run-2' AS run, 0 AS src, similarity, reasons FROM sm WHERE a <> b AND similarity >= 0.4::DOUBLE UNION ALL SELECT a, b, 'run-1', 1, similarity, reasons FROM sm WHERE similarity >= 0.4::DOUBLE),
er AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b, src, run) AS rank FROM ev)
SELECT a AS incident_id, b AS match, run AS match_run, similarity, rank::INTEGER AS rank, reasons, cast(1 AS bigint) AS runs_compared FROM er WHERE rank <= 5""")
def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = io.kept(_signatures(spark, sf_dir))
    return patterns.similar_incidents(s, s.withColumn("run_id", F.lit("run-1"))).withColumn("reasons", F.array_join("reasons", "; "))


# ------------------------------------------------------------------ reports, archive, actions


@_query(_WEEKLY + f" SELECT us // {MINUTE} * {MINUTE} AS minute_us, coalesce(incident_id, 'NOISE') AS owner, count(*) AS n FROM alarms LEFT JOIN mem USING (alarm_id) GROUP BY 1, 2")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, a = _members(spark, sf_dir, True)
    return reports.timeline(a, m.withColumnRenamed("incident_id", "owner"))


@_query(_WEEKLY + f", t AS (SELECT us // {MINUTE} * {MINUTE} AS minute_us, coalesce(incident_id, 'NOISE') AS owner, count(*) AS n FROM alarms LEFT JOIN mem USING (alarm_id) GROUP BY 1, 2) SELECT m.minute_us, o.owner, coalesce(n, 0) AS n FROM (SELECT DISTINCT minute_us FROM t) m CROSS JOIN (SELECT DISTINCT owner FROM t) o LEFT JOIN t ON t.minute_us = m.minute_us AND t.owner = o.owner")
def timeline_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline_filled(timeline(spark, sf_dir))


_SUMMARY = _LEDGER + "," + _SLOTS + """, sc0 AS (SELECT (SELECT count(*) FROM alarms) AS raw, (SELECT count(*) FROM ruled WHERE rule IS NULL) AS signal, (SELECT count(*) FROM inc) AS clusters, (SELECT count(*) FROM mem) AS clustered, (SELECT count(*) FROM gt) AS incidents, (SELECT count(*) FROM gt WHERE passes) AS passing,
  (SELECT count(*) FROM sl WHERE slot = 'card') AS own_cards, (SELECT count(*) FROM sl WHERE slot = 'bucket') AS rolled_up, (SELECT count(*) FROM sl WHERE slot = 'card') + (SELECT count(DISTINCT slot) FROM sl WHERE slot = 'bucket') AS cards,
  (SELECT count(*) FROM mem JOIN sl ON sl.incident_id = mem.incident_id WHERE slot = 'card') AS linked, (SELECT count(*) FROM mem JOIN sl ON sl.incident_id = mem.incident_id WHERE slot = 'bucket') AS unclassified, (SELECT count(*) FROM lg WHERE rule IS NOT NULL) AS noise),
su AS (SELECT *, floor(raw / cast(greatest(1, cards) AS double) * 10.0 + 0.5) / 10.0 AS reduction, floor(cast(noise AS double) / greatest(1, raw) * 100.0 * 10.0 + 0.5) / 10.0 AS noise_percent, floor(cast(unclassified AS double) / greatest(1, raw) * 100.0 * 10.0 + 0.5) / 10.0 AS unclassified_percent FROM sc0)"""


@_query(_SUMMARY + " SELECT * FROM su")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures where each week's failing services are clusters and incidents alike."""
    capped, gated, m, a = _ranked(spark, sf_dir)
    capped, gated, ruled = io.kept(capped), io.kept(gated), _classified(spark, sf_dir, a)
    formed = cluster.cluster_summary(m.select("alarm_id", F.col("incident_id").alias("cluster_id"), F.lit("burst").alias("window_kind")), a)
    entries = noise.ledger(ruled, m, m.join(gated.where("passes").select("incident_id"), "incident_id", "left_semi"))
    return reports.summary(a, ruled, formed, gated, capped, cards.membership(capped, m), entries)


@_query(_SUMMARY + " SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step, unnest(['raw', 'signal', 'clusters', 'incidents', 'own_cards']) AS stage, unnest([raw, signal, clusters, incidents, own_cards])::BIGINT AS n FROM su")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(summary(spark, sf_dir))


@_query(_WEEKLY + " SELECT alarm_id, us, service, severity FROM ma WHERE incident_id = 'INC-1' ORDER BY us, alarm_id LIMIT 600")
def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_log(*_members(spark, sf_dir, True), "INC-1").select("alarm_id", "us", "service", "severity")


_HIST = "hist AS (SELECT 'run-' || cast(user_id AS varchar) AS run_id, alarm_id AS incident_id, event_id AS seq FROM events JOIN alarms ON alarm_id = 'ALM-' || lpad(cast(event_id AS varchar), 8, '0'))"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.concat(F.lit("ALM-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("incident_id"), F.col("event_id").alias("seq"))


@_query(_HIST + ", r AS (SELECT run_id, min(seq) AS first FROM hist WHERE run_id <> 'run-7' GROUP BY run_id ORDER BY first DESC LIMIT 19) SELECT run_id, incident_id, seq FROM hist WHERE run_id IN (SELECT run_id FROM r)")
def retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.retained_runs(_history(spark, sf_dir), "run-7").select("run_id", "incident_id", "seq")


_EV = "ev AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS us, event_type FROM events)"
_STATUS = "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'resolved' WHEN 'view' THEN 'open' ELSE 'closed' END"


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records for even users, and every event as a change of status."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")
    e = e.withColumn("incident_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    records = e.where("user_id % 2 = 0").groupBy("incident_id").agg(F.min("us").alias("created_us")).select("incident_id", F.lit("open").alias("status"), F.lit("platform-oncall").alias("owner"), F.lit("look").alias("action"), "created_us", F.col("created_us").alias("updated_us"))
    return records, e.select("incident_id", F.expr(_STATUS).alias("status"), F.lit("").alias("owner"), F.lit("").alias("note"), "us", "seq")


_TRANS = _EV + f""", ch AS (SELECT 'u' || cast(user_id AS varchar) AS incident_id, {_STATUS} AS status, us, seq, user_id FROM ev),
tr AS (SELECT incident_id, coalesce(lag(status) OVER w, 'open') AS previous_status, status, us, seq FROM ch WHERE user_id % 2 = 0 AND status <> 'closed' WINDOW w AS (PARTITION BY incident_id ORDER BY us, seq)),
cur AS (SELECT 'u' || cast(user_id AS varchar) AS incident_id, coalesce((SELECT t.status FROM (SELECT incident_id, status, row_number() OVER (PARTITION BY incident_id ORDER BY us DESC, seq DESC) AS k FROM tr) t WHERE t.k = 1 AND t.incident_id = 'u' || cast(user_id AS varchar)), 'open') AS status FROM (SELECT DISTINCT user_id FROM ev WHERE user_id % 2 = 0))"""


@_query(_TRANS + " SELECT incident_id, previous_status, status, previous_status || ' -> ' || status AS note, us, seq FROM tr")
def action_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.action_timeline(actions.apply_transitions(*_changes(spark, sf_dir))[1]).select("incident_id", "previous_status", "status", "note", "us", "seq")


@_query(_TRANS + " SELECT incident_id, status FROM cur")
def apply_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.apply_transitions(*_changes(spark, sf_dir))[0].select("incident_id", "status")


@_query(_TRANS + " SELECT s.status, count(cur.status) AS n FROM (VALUES ('open'), ('in_progress'), ('resolved')) s(status) LEFT JOIN cur ON cur.status = s.status GROUP BY s.status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.status_counts(actions.apply_transitions(*_changes(spark, sf_dir))[0])


@_query(_TRANS + " SELECT incident_id, status, us, CASE WHEN status = 'closed' THEN 'invalid status' ELSE 'unknown incident' END AS error FROM ch WHERE status = 'closed' OR user_id % 2 = 1")
def rejected_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.apply_transitions(*_changes(spark, sf_dir))[2]


_KEPT = "ef AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY incident_id ORDER BY us, seq), 'open') AS before FROM ch WHERE user_id % 2 = 0 AND status <> 'closed')"


@_query(_TRANS + "," + _KEPT + " SELECT incident_id, before AS previous_status, status, us, seq FROM ef WHERE status <> before")
def enforced_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only moves to another status count; a move to the same one changes nothing, so the status before is that of the change before."""
    return actions.apply_transitions(*_changes(spark, sf_dir), actions.MOVES)[1].select("incident_id", "previous_status", "status", "us", "seq")


@_query(_TRANS + "," + _KEPT + " SELECT incident_id, count(*) FILTER (WHERE status <> before) + 1 AS n_history, (SELECT min(us) FROM ev WHERE 'u' || cast(user_id AS varchar) = ef.incident_id) AS opened_us, max(us) FILTER (WHERE status <> before) AS last_us FROM ef GROUP BY incident_id HAVING count(*) FILTER (WHERE status <> before) > 0")
def action_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their nested histories, read back through the histories."""
    records, changes = _changes(spark, sf_dir)
    current, moved, _ = actions.apply_transitions(records, changes, actions.MOVES)
    nested = actions.with_history(current, moved)
    ends = actions.history_timeline(nested).groupBy("incident_id").agg(F.min("us").alias("opened_us"), F.max(F.when(F.col("seq") >= 0, F.col("us"))).alias("last_us"))
    return nested.select("incident_id", "n_history").join(ends, "incident_id").where("last_us IS NOT NULL")


@_query(_TRANS + ", cards AS (SELECT 'u' || cast(user_id AS varchar) AS incident_id, min(us) AS created_us FROM ev WHERE user_id % 3 = 0 GROUP BY user_id) SELECT incident_id, coalesce(cur.status, 'open') AS status, 'database-oncall' AS owner FROM cards LEFT JOIN cur USING (incident_id)")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = actions.apply_transitions(*_changes(spark, sf_dir))[0]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 3 = 0")
    new = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("incident_id")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("created_us"))
    new = new.withColumn("owner", F.lit("database-oncall")).withColumn("action", F.lit("look"))
    return actions.sync_actions(current, new).select("incident_id", "status", "owner")


@_query(_TRANS + ", l AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq DESC) AS k FROM ch) SELECT incident_id, status, us, seq FROM l WHERE k = 1")
def latest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.latest_actions(_changes(spark, sf_dir)[1]).select("incident_id", "status", "us", "seq")
