"""Session factory and small session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app: str = "marginalia", **conf: str) -> SparkSession:
    """Session with the settings the plans expect; a cluster's own settings win where given."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package; on a cluster ship it with --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join(p for p in (ROOT, *paths) if p)
    return spark


def computed(df: DataFrame) -> DataFrame:
    """df, computed now and kept on the executors' disks as long as it is used; plans begin anew from its rows."""
    return df.localCheckpoint(True, StorageLevel.DISK_ONLY)
