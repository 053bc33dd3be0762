"""Session factory and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


_LOCAL: list[str] = []
_TABLES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only where the setting is missing, as in local tests, a temporary folder is made and removed
    when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor costs nothing but its running tasks, as every later stage starts at the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this process has materialized; results that still read them must be written first."""
    paths, done = _TABLES[:], 0
    _TABLES.clear()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done
