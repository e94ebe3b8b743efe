"""Sinks: tables, review files, work lists and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def append(df: DataFrame, path: str) -> None:
    """Adds the rows to a Parquet table; a failed job adds none."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> str:
    """A new version of the table below path, whole or not at all, and its place; readers of older ones aren't touched.
    Versions are numbered by the rows' commit, so the newest is the last by name."""
    spark = df.sparkSession
    version = spark.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSSSSS') AS v").first()["v"]
    place = f"{path.rstrip('/')}/v={version}"
    df.write.parquet(place)
    return place


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table's newest whole version."""
    every = spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.col("_metadata.file_path").alias("p"))
    last = every.select(F.max(F.regexp_extract("p", r"/v=(\d+)/", 1)).alias("v")).first()["v"]
    return spark.read.parquet(f"{path.rstrip('/')}/v={last}")


def write_review(df: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte-order mark, in the order of the rows: for a person to open. Reviews are
    small; arrays are joined before."""
    first, *rest = df.columns
    df.withColumnRenamed(first, BOM + first).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_audit(changes: DataFrame, path: str) -> None:
    """Adds (book_id, before, after) to a log of JSON lines; nothing that it holds is changed."""
    changes.select("book_id", "before", "after").write.mode("append").option("ignoreNullFields", "false").json(path)


def pack(df: DataFrame, path: str) -> None:
    """A table as gzip-compressed Parquet, for storage."""
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def readable_gzip(spark: SparkSession, path: str) -> bool:
    """Whether the file begins as gzip does and its first line can be read."""
    try:
        spark.read.text(path).limit(1).collect()
    except Exception as e:  # noqa: BLE001  the reader's error class says whether the file is at fault
        if "FAILED_READ_FILE" in str(e):
            return False
        raise
    return True
