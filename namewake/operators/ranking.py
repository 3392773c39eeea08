"""Ranks over a whole table without sending it through one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a session without one (a local test) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` now as a table in the shared folder. A checkpoint keeps the estimated size of its plan, which loops of joins multiply without end; a table's is that of its files."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds each row's place in a total order, from 1: sorted ranges are numbered apart and shifted by the rows before them."""
    ranged = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, place).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_part", "_before")
