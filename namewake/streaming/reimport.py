"""Import of daily folders that takes a day anew when its source files have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import read_or_empty

MANIFEST = "day string, signature string, files long, run int"


def signatures(spark: SparkSession, source: str) -> DataFrame:
    """(day, signature, files): what the files of each ``day=`` folder look like now; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    one = F.concat_ws(":", F.regexp_extract("path", r"[^/]+$", 0), "length", F.unix_micros("modificationTime"))
    by_day = files.select(F.regexp_extract("path", r"/day=([^/]+)/", 1).alias("day"), one.alias("file")).where("day <> ''").groupBy("day")
    return by_day.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("file")), "|"), 256).alias("signature"), F.count("*").alias("files"))


def imported(spark: SparkSession, manifest: str) -> DataFrame:
    """(day, signature, files, run, imports): the latest import of each day, and how many there were."""
    runs = read_or_empty(spark, manifest, MANIFEST)
    latest = F.max(F.struct("run", "signature", "files")).alias("last")
    return runs.groupBy("day").agg(latest, F.count("*").alias("imports")).select("day", "last.signature", "last.files", "last.run", "imports")


def reimport(spark: SparkSession, source: str, target: str, manifest: str) -> DataFrame:
    """Bring ``target`` (partitioned by ``day``) up to the daily folders of ``source``; returns the (day, signature, files, run) that were taken.

    Only days that are new or whose signature differs from the manifest's are read and replaced, each as a whole; other days keep their files, and so does a day
    whose source is gone. The manifest is written last: a run that is cut before takes the same days again, with the same result. Signatures
    are a row for each day; the list of changed days is all that the driver holds.
    """
    known = imported(spark, manifest)
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    changed = signatures(spark, source).join(known.select("day", "signature"), ["day", "signature"], "left_anti").withColumn("run", F.lit(run))
    rows = changed.select("day", "signature", "files", "run").collect()
    taken = spark.createDataFrame(rows, MANIFEST)
    if rows:
        days = spark.read.option("basePath", source).parquet(*[f"{source}/day={r.day}" for r in rows])
        days.withColumn("day", F.col("day").cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
        taken.coalesce(1).write.mode("append").parquet(manifest)
    return taken
