"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. They are defaults for sessions built here; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "fleetdrift", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitter owns the session."""
    cores = cpus or os.cpu_count() or 8
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers, once per application."""
    context = spark.sparkContext
    if not any(name.startswith(f"{PACKAGE.name}.") for name in context._python_includes):
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))


def work_root(spark: SparkSession) -> str:
    """The folder that survives the loss of an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors share the
    driver's disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="fleetdrift-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder; never reused, so a retry cannot see a half-written one."""
    return f"{work_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` out and read it back: a plan break whose data outlives any executor."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The results of an iterative search, one folder per round below one table in the shared work folder.

    A search of many rounds reads what it has found as one table, whose plan does not grow with the rounds.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count, self.schema = spark, work_path(spark, label), 0, None

    def add(self, rows: DataFrame) -> DataFrame:
        """Write one round and return it as read back."""
        folder = f"{self.path}/round={self.count}"
        rows.write.parquet(folder)
        self.count += 1
        self.schema = self.schema or rows.schema
        return self.spark.read.schema(self.schema).parquet(folder)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)
