"""Sources and sinks: alarms, hosts, dependencies, the incident archive, action records, result documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def _folder(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares; only a local session may do without a shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{shared.rstrip('/')}/stormsift-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the folder that the cluster shares."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that the cluster shares (below the warehouse in a local session without one, as in tests).

    Steps that read a table several times then plan on a scan, not on copies of its whole lineage, and lost executors
    cost no more than the step at hand.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes all tables that this application kept; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ALARM_COLUMNS = ("alarm_id", "timestamp", "source_system", "host", "service", "severity", "alarm_type", "message", "veri_merkezi", "kabin", "ortam")
_TAGS = {"veri_merkezi": "datacenter", "kabin": "rack", "ortam": "environment"}
_STRINGS = T.StructType([T.StructField(c, T.StringType()) for c in ALARM_COLUMNS])


def _typed(raw: DataFrame) -> DataFrame:
    trimmed = raw.select(*(F.trim(F.col(c)).alias(_TAGS.get(c, c)) for c in ALARM_COLUMNS))
    return trimmed.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp"))).withColumn("severity", F.col("severity").cast("int")).drop("timestamp")


def read_alarms_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells are strings and trimmed; a bad timestamp or severity raises (ANSI casts)."""
    return _typed(spark.read.schema(_STRINGS).option("header", True).option("mode", "FAILFAST").csv(path))


def read_alarms_json(spark: SparkSession, path: str) -> DataFrame:
    tags = T.StructType([T.StructField(c, T.StringType()) for c in _TAGS])
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ALARM_COLUMNS if c not in _TAGS), T.StructField("tags", tags)])
    return _typed(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", "tags.*").drop("tags"))


def _last(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key in file order."""
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return numbered.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), "_at").alias("_r")).select(key, "_r.*")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "servis", "veri_merkezi", "kabin", "ortam", "is_kritikligi")])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    names = ("host", "service", "datacenter", "rack", "environment", "criticality")
    return _last(raw.select(*(F.trim(F.col(a)).alias(b) for a, b in zip(raw.columns, names, strict=True))), "host")


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("kaynak_servis", "hedef_servis", "bagimlilik_tipi", "kritiklik")])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(*(F.trim(F.col(a)).alias(b) for a, b in zip(raw.columns, ("source", "target", "kind", "criticality"), strict=True)))


#: Columns of the incident archive, those of `patterns.signatures`, and of the action records.
HISTORY = "incident_id string, run_id string, occurred_us long, root_type string, root_service string, services array<string>, locations array<string>, type_histogram map<string,double>, max_severity int, alarm_count long, duration_min double, seq long"
ACTIONS = "incident_id string, status string, owner string, action string, created_us long, updated_us long, seq long"


def _store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or one without rows where nothing was written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return _store(spark, path, HISTORY)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """One record per incident_id, the last by seq; records without an incident_id are skipped."""
    return latest_actions(_store(spark, path, ACTIONS))


def write_actions(records: DataFrame, path: str) -> None:
    """Replaces the records at path; they are kept first, since they may have been read from there."""
    kept(records).write.mode("overwrite").parquet(path)


def retained_runs(history: DataFrame, run_id: str, max_runs: int = 20) -> DataFrame:
    """Rows of the archive that stay when run_id is appended: other runs, the last max_runs - 1 in order of first sight (column seq)."""
    others = history.where(F.col("run_id") != run_id)
    runs = others.groupBy("run_id").agg(F.min("seq").alias("first"))
    keep = runs.orderBy(F.col("first").desc()).limit(max_runs - 1).select("run_id")
    return others.join(keep, "run_id", "left_semi")


def append_history(history: DataFrame, signatures: DataFrame, run_id: str, max_runs: int = 20) -> DataFrame:
    return retained_runs(history, run_id, max_runs).unionByName(signatures, allowMissingColumns=True)


def latest_actions(actions: DataFrame) -> DataFrame:
    """One record per incident_id, the last by seq; records without one are skipped."""
    known = actions.where("incident_id IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("incident_id").orderBy(F.col("seq").desc()))
    return known.withColumn("_k", rank).where("_k = 1").drop("_k")


#: Columns that tables of a result are partitioned by as files: the ledger by rule, alarms by the card that holds them.
_PARTED = {"ledger": "rule", "membership": "card_id"}


def write_outputs(result: dict[str, DataFrame], path: str) -> None:
    """Each table of the result as Parquet below path."""
    for name, df in result.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(_PARTED[name]) if name in _PARTED else writer).parquet(f"{path}/{name}")


def read_outputs(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
