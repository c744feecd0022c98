"""The archive of past runs: a folder for each written run, and a manifest that says which of them count."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.sources.io import HISTORY


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so that any store Spark can write to will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, list[dict]]]:
    """(number, runs) of the manifests that can be read, the newest first; a run is its id and folder, in order of first sight."""
    out = []
    for name in reversed(_names(spark, f"{path}/manifest")):
        if name.endswith(".json"):
            text = "".join(r[0] for r in spark.read.text(f"{path}/manifest/{name}", wholetext=True).collect())  # one small file
            try:
                out.append((int(name.removesuffix(".json")), json.loads(text)["runs"]))
            except (ValueError, KeyError, TypeError):
                continue  # cut off or damaged: the one before counts
    return out


def archived_runs(spark: SparkSession, path: str) -> list[str]:
    found = _manifests(spark, path)
    return [r["run_id"] for r in found[0][1]] if found else []


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of the runs that the newest readable manifest names; no rows where there is none.

    A run that was being written when its job died has no manifest, so the archive reads as before it.
    """
    found = _manifests(spark, path)
    runs = found[0][1] if found else []
    if not runs:
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(*(f"{path}/{r['folder']}" for r in runs))


def append_run(signatures: DataFrame, path: str, run_id: str, max_runs: int = 20) -> None:
    """Adds a run to the archive at path, in place of an earlier one of that id, and drops all but the last max_runs.

    The run's files go to a folder of their own first; then one rename puts a new manifest in place, which is the moment
    the archive changes; then folders and manifests that it no longer names are deleted, also those left behind by jobs
    that died. Two writers at once: the second finds its manifest taken and raises.
    """
    spark = signatures.sparkSession
    found = _manifests(spark, path)
    number = 1 + max((int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifest") if n.endswith(".json")), default=0)
    folder = f"runs/{quote(run_id, safe='')}-{uuid.uuid4().hex}"
    known = {c.split()[0] for c in HISTORY.split(", ")}
    missing = known - set(signatures.columns) - {"seq", "run_id"}
    if missing:
        raise ValueError(f"signatures lack {sorted(missing)}")
    rows = signatures.withColumn("run_id", F.lit(run_id)).withColumn("seq", F.lit(number).cast("long"))
    rows.select(*(F.col(c.split()[0]).cast(c.split(maxsplit=1)[1]) for c in HISTORY.split(", "))).write.parquet(f"{path}/{folder}")
    others = [r for r in (found[0][1] if found else []) if r["run_id"] != run_id]
    runs = [*others[len(others) - min(len(others), max_runs - 1) :], {"run_id": run_id, "folder": folder}]
    _publish(spark, path, number, runs)
    _clean(spark, path, number, runs)


def _publish(spark: SparkSession, path: str, number: int, runs: list[dict]) -> None:
    fs, draft = _files(spark, f"{path}/manifest/{number:012d}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"runs": runs}).encode()))
    out.close()
    _, final = _files(spark, f"{path}/manifest/{number:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"manifest {number} is taken: another run was appended meanwhile")


def _clean(spark: SparkSession, path: str, number: int, runs: list[dict]) -> None:
    live = {r["folder"] for r in runs}
    old = [f"manifest/{n}" for n in _names(spark, f"{path}/manifest") if n != f"{number:012d}.json" and n[:12] <= f"{number:012d}"]
    for name in old + [f"runs/{n}" for n in _names(spark, f"{path}/runs") if f"runs/{n}" not in live]:
        fs, at = _files(spark, f"{path}/{name}")
        fs.delete(at, True)
