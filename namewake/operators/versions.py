"""Tables that are folded forward: each fold writes a new version, and a log names the one that counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The version that the log names last."""
    last = read_or_empty(spark, f"{folder}/log", "n int, version string").orderBy("n").tail(1)
    return read_or_empty(spark, f"{folder}/{last[0].version}", schema) if last else spark.createDataFrame([], schema)


def advance(table: DataFrame, folder: str) -> None:
    """Write a new version, then name it in the log: a run that is cut between leaves the old version in force."""
    spark = table.sparkSession
    version = f"version-{uuid.uuid4()}"
    table.write.parquet(f"{folder}/{version}")
    n = read_or_empty(spark, f"{folder}/log", "n int, version string").count()
    spark.createDataFrame([(n + 1, version)], "n int, version string").coalesce(1).write.mode("append").parquet(f"{folder}/log")
