"""Watching for new networks: each id is processed once, failed ones too unless they are to be retried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "id", retry_errors: bool = False, once: bool = True, every: str = "10 seconds"):
    """Start a query that sends records of new files in folder through `process` and appends to `results` (Parquet).

    Records whose key is in the results, or was earlier in the batch, are left out, so a restart repeats
    nothing; rows with an error count as done unless retry_errors. once: what is there now, then stop.
    """
    stream = spark.readStream.schema(schema).json(folder)

    def each(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if _exists(session, results):
            done = session.read.parquet(results)
            if retry_errors:
                done = done.where(F.col("error").isNull())
            fresh = fresh.join(done.select(key).distinct(), key, "left_anti")
        process(fresh).write.mode("append").parquet(results)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
