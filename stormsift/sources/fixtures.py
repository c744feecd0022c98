"""Alarms, hosts and dependencies derived from the events table, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS = ("network_down", "disk_full", "ext_unreach", "oom_risk", "batch_overlap")
_SYMPTOMS = ("timeout", "http_5xx", "latency_high", "conn_refused", "txn_fail", "db_write_fail")
_OTHERS = ("cert_expiry", "backup_warn", "ntp_drift", "log_rotate", "disk_warn", "network_flap", "cpu_high", "mem_high", "latency_high", "timeout")
_SYSTEMS = ("OBM", "Prometheus", "Zabbix", "AppDynamics", "SyslogNG")
_CRITICALITY = ("kritik", "yuksek", "orta", "dusuk")
#: 2024-01-01 02:00:00 UTC in microseconds.
_STORMS = 1_704_074_400_000_000


def _pick(values: tuple[str, ...], at: str) -> str:
    return f"CASE ({at}) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _columns(div: str, text: str, conflicts: bool) -> dict[str, list[tuple[str, str]]]:
    """Steps of select expressions that Spark and DuckDB both read; div is the integer division of the engine."""
    d = lambda a, b: div.format(a=a, b=b)
    pad = lambda x, n: f"lpad(cast({x} AS {text}), {n}, '0')"
    first = [
        ("s0", "CASE (event_id % 4) WHEN 0 THEN w WHEN 1 THEN 2 * w + 1 WHEN 2 THEN 2 * w + 2 ELSE (w + 13) % 27 END"),
        ("d", "CASE WHEN w % 2 = 0 THEN 600 ELSE 4800 END"),
    ]
    second = [("h", f"CASE WHEN storm THEN s0 + 27 * ({d('event_id', 4)} % 2) ELSE event_id % 56 END")]
    rack = _pick(("rack-A", "rack-B", "rack-C"), "(h + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) % 3" if conflicts else "h % 3")
    host = f"CASE WHEN event_id % 101 = 0 THEN concat('stray-', {pad('h', 2)}) ELSE concat('host-', {pad('h', 2)}) END" if conflicts else f"concat('host-', {pad('h', 2)})"
    third = [
        ("alarm_id", f"concat('ALM-', {pad('event_id', 8)})"),
        ("us", f"CASE WHEN storm THEN {_STORMS} + (604800 * cast(w AS bigint) + 60 * (event_id % 4) + (event_id * 37) % d) * 1000000 ELSE us0 END"),
        ("source_system", _pick(_SYSTEMS, "event_id % 5")),
        ("host", host),
        ("service", f"concat('svc-', {pad('CASE WHEN storm THEN s0 ELSE h % 27 END', 2)})"),
        ("severity", "cast(CASE WHEN storm AND k % 5 = 1 THEN 2 + k % 2 WHEN storm THEN 4 + k % 2 ELSE 1 + least(4, floor(value / 40)) END AS int)"),
        ("alarm_type", f"CASE WHEN storm AND event_id % 4 = 0 AND k % 3 = 0 THEN {_pick(_ROOTS, 'w')} WHEN storm THEN {_pick(_SYMPTOMS, 'k % 6')} ELSE {_pick(_OTHERS, 'k % 10')} END"),
        ("datacenter", f"concat('dc', cast(1 + h % 2 AS {text}))"),
        ("rack", rack),
        ("environment", "'prod'"),
        ("week", "w"),
        ("storm", "storm"),
    ]
    return {"first": first, "second": second, "third": third}


def _as(pairs: list[tuple[str, str]]) -> list[str]:
    return [f"{e} AS {n}" for n, e in pairs]


def alarms(spark: SparkSession, sf_dir: str, conflicts: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(
        "event_id", "value", (F.col("event_type") == "error").alias("storm"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr("cast(datediff(cast(ts AS date), DATE '2024-01-01') DIV 7 AS int)").alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us0"),
    )
    c = _columns("({a} DIV {b})", "string", conflicts)
    a = e.selectExpr("*", *_as(c["first"])).selectExpr("*", *_as(c["second"])).selectExpr("value", *_as(c["third"]))
    return a.withColumn("message", F.concat_ws(" ", "alarm_type", F.floor("value").cast("string"))).drop("value")


def hosts(spark: SparkSession) -> DataFrame:
    h = spark.range(56).select(F.col("id").cast("int").alias("h"))
    return h.selectExpr("concat('host-', lpad(cast(h AS string), 2, '0')) AS host", "concat('svc-', lpad(cast(h % 27 AS string), 2, '0')) AS service", "concat('dc', cast(1 + h % 2 AS string)) AS datacenter", f"{_pick(('rack-A', 'rack-B', 'rack-C'), 'h % 3')} AS rack", "'prod' AS environment", f"{_pick(_CRITICALITY, '(h % 27) % 4')} AS criticality")


def dependencies(spark: SparkSession) -> DataFrame:
    i = spark.range(27).select(F.col("id").cast("int").alias("i"))
    edges = i.where("i > 0").selectExpr("i", "(i - 1) DIV 2 AS t").union(i.where("i IN (0, 4, 8, 12, 16, 24)").selectExpr("i", "(5 * i + 1) % 27 AS t"))
    return edges.selectExpr("concat('svc-', lpad(cast(i AS string), 2, '0')) AS source", "concat('svc-', lpad(cast(t AS string), 2, '0')) AS target", "CASE WHEN i % 2 = 0 THEN 'senkron' ELSE 'asenkron' END AS kind", f"{_pick(_CRITICALITY, 't % 4')} AS criticality")


def sql(conflicts: bool = False) -> str:
    """The CTEs alarms, hosts and edges for DuckDB."""
    c = _columns("({a} // {b})", "varchar", conflicts)
    pick = lambda values, at: _pick(values, at)
    return f"""
e0 AS (SELECT event_id, value, event_type = 'error' AS storm, cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS int) AS k,
       cast(date_diff('day', DATE '2024-01-01', cast(ts AS date)) // 7 AS int) AS w, epoch_us(ts) AS us0 FROM events),
e1 AS (SELECT *, {", ".join(_as(c["first"]))} FROM e0),
e2 AS (SELECT *, {", ".join(_as(c["second"]))} FROM e1),
alarms AS (SELECT {", ".join(_as(c["third"]))}, alarm_type || ' ' || cast(cast(floor(value) AS bigint) AS varchar) AS message FROM e2),
hosts AS (SELECT 'host-' || lpad(cast(h AS varchar), 2, '0') AS host, 'svc-' || lpad(cast(h % 27 AS varchar), 2, '0') AS service, 'dc' || cast(1 + h % 2 AS varchar) AS datacenter,
          {pick(("rack-A", "rack-B", "rack-C"), "h % 3")} AS rack, 'prod' AS environment, {pick(_CRITICALITY, "(h % 27) % 4")} AS criticality FROM range(56) t(h)),
edges AS (SELECT 'svc-' || lpad(cast(i AS varchar), 2, '0') AS source, 'svc-' || lpad(cast(t AS varchar), 2, '0') AS target, CASE WHEN i % 2 = 0 THEN 'senkron' ELSE 'asenkron' END AS kind, {pick(_CRITICALITY, "t % 4")} AS criticality FROM
          (SELECT i, (i - 1) // 2 AS t FROM range(1, 27) r(i) UNION ALL SELECT i, (5 * i + 1) % 27 FROM range(27) r(i) WHERE i IN (0, 4, 8, 12, 16, 24)))"""
