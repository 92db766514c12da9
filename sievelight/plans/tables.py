"""Input tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df for work that is heavy on each row: dealt to all cores if its scan has fewer
    partitions than there are (a small file of one row group is read by one task). A
    large table has more and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir. Without that setting
    a session on one machine gets a local one; a cluster's is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievelight-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
