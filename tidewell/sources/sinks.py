"""Staged outputs: Parquet or CSV with a manifest, and tables staged for reuse."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS, MAX_BYTES = 50_000_000, 10 << 30
#: Seconds after which a staged output is stale.
KEPT_SECONDS = 24 * 3600


class QuotaError(ValueError):
    """A staged output over its quota."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and there is one machine, as in tests, a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread, so that it is computed once and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_output(df: DataFrame, path: str, form: str = "parquet", contract: dict | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict:
    """Writes a result beside a one-row JSON manifest; refuses an existing path and a result over quota.

    The rows go to a path of their own first, are counted there, so that an
    expensive plan runs once, and are renamed when they are within quota; of a
    result over quota nothing stays.
    """
    spark = df.sparkSession
    files, target = _files(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    _, draft = _files(spark, f"{path}.draft-{uuid.uuid4().hex}")
    try:
        writer = df.write.mode("errorifexists")
        writer.option("header", True).csv(draft.toString()) if form == "csv" else writer.parquet(draft.toString())
        back = spark.read.schema(df.schema).option("header", True).csv(draft.toString()) if form == "csv" else spark.read.schema(df.schema).parquet(draft.toString())
        rows, size = back.count(), files.getContentSummary(draft).getLength()
        if rows > max_rows or size > max_bytes:
            raise QuotaError(f"{rows} rows in {size} bytes; at most {max_rows} and {max_bytes} are allowed")
        manifest = {"version": 2, "format": form, "rows": rows, "bytes": size, "columns": [[c, t] for c, t in df.dtypes], "contract": contract or {}, "written": int(time.time())}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")
        if not files.rename(draft, target):
            raise FileExistsError(path)
        return manifest
    finally:
        files.delete(draft, True)


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The manifest of a staged output, its parts checked."""
    found = json.loads(spark.read.text(f"{path}.manifest").first()["value"])
    if found.get("version") != 2 or found.get("format") not in ("parquet", "csv") or not isinstance(found.get("rows"), int) or not found.get("columns"):
        raise ValueError("the manifest is damaged")
    return found


def read_output(spark: SparkSession, path: str, contract: dict | None = None) -> DataFrame:
    """A staged output, after its manifest has been checked against the contract."""
    manifest = manifest_of(spark, path)
    if contract is not None and manifest["contract"] != contract:
        raise ValueError("the staged output has another contract")
    schema = ", ".join(f"`{c}` {t}" for c, t in manifest["columns"])
    return spark.read.schema(schema).option("header", True).csv(path) if manifest["format"] == "csv" else spark.read.schema(schema).parquet(path)


def staged_path(spark: SparkSession, root: str, name: str, contract: dict | None = None, now: float | None = None) -> str:
    """Where a staged output below root is: its name may not lead out of root, it may not be stale, its contract must be the one given."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*(/[A-Za-z0-9_-][A-Za-z0-9_.-]*)*", name):
        raise ValueError("no name of a staged output")
    path = f"{root.rstrip('/')}/{name}"
    manifest = manifest_of(spark, path)
    if (now or time.time()) - manifest["written"] > KEPT_SECONDS:
        raise ValueError("the staged output is stale")
    if contract is not None and manifest["contract"] != contract:
        raise ValueError("the staged output has another contract")
    return path


def drop_stale(spark: SparkSession, root: str, now: float | None = None) -> list[str]:
    """Deletes the staged outputs below root that are stale; their names."""
    files, at = _files(spark, root)
    gone = []
    for status in files.listStatus(at) if files.exists(at) else ():
        name = status.getPath().getName()
        if name.endswith(".manifest"):
            path = f"{root.rstrip('/')}/{name.removesuffix('.manifest')}"
            if (now or time.time()) - manifest_of(spark, path)["written"] > KEPT_SECONDS:
                for each in (path, f"{path}.manifest"):
                    files.delete(_files(spark, each)[1], True)
                gone.append(name.removesuffix(".manifest"))
    return sorted(gone)


def write_cohort(cohort: DataFrame, path: str, definition: int) -> None:
    """Replaces one definition's partition of a stored cohort table."""
    cohort.withColumn("cohort_definition_id", F.lit(definition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort_definition_id").parquet(path)
