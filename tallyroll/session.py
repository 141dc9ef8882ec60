"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Scoring is CPU-bound, so small shuffles may still use every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers; needed where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='tallyroll-')}/{root.name}", "zip", root.parent, root.name
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def build_session(master: str, app: str = "tallyroll", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, whose executors are this process, may do without: it
    gets a temporary one. A cluster that names none is an error, since each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        handle = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = handle.get() if handle.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyroll-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused sub-folder of the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table of the shared folder: computed once, no lineage."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
