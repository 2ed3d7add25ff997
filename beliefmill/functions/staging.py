"""Written intermediate tables, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session takes a temporary folder, a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, name: str, conditions: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """The written table, and how many of its rows meet each condition; the pass that writes counts them."""
    seen = Observation()
    table = written(df.observe(seen, *(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items())), name)
    return table, dict(seen.get)
