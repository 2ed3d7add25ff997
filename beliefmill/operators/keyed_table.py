"""Tables that a batch of new rows changes in the places of its keys only."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_folder

SLOT = "key_slot"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class KeyedTable:
    """A Parquet table whose rows lie by their key in slots, which are partitions, and in a slot in buckets, sorted.

    A batch is put in by rewriting the slots of its keys. The slots' old rows are read bucket by bucket, so
    only the batch is shuffled; other slots are neither read nor written. A rewrite is moved in when all of
    it is written, so one that fails changes nothing. Rows are one a key; of a batch with several rows of a
    key any one is kept. Null keys are a key.
    """

    def __init__(self, spark: SparkSession, key: str, slots: int = 64, buckets: int = 16, path: str | None = None):
        self.spark, self.key, self.slots, self.buckets = spark, key, slots, buckets
        self.name = f"keyed_{uuid.uuid4().hex}"
        self.path = path or f"{shared_folder(spark)}/{self.name}"

    def slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.slots)).cast("int")  # a null key has the hash's seed

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(SLOT, self.slot(F.col(self.key)))

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the first rows, one a key."""
        placed = self._placed(rows).repartition(self.buckets, self.key)
        placed.write.partitionBy(SLOT).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).format("parquet").saveAsTable(self.name)
        self.columns = rows.columns
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def merged(self, batch: DataFrame, touched: list[int], nulls: bool = False) -> DataFrame:
        """What the touched slots will hold: the batch, and the old rows whose key isn't in it; nulls: whether a key of it is null."""
        new = self._placed(batch.select(*self.columns)).dropDuplicates([self.key])
        old = self.spark.table(self.name).where(F.col(SLOT).isin(touched)).select(*self.columns, SLOT)
        kept = old.join(new.select(self.key).hint("shuffle_merge"), self.key, "left_anti").select(*self.columns, SLOT)
        kept = kept.where(F.col(self.key).isNotNull()) if nulls else kept
        return kept.unionByName(new)

    def upsert(self, batch: DataFrame) -> list[int]:
        """Put the batch in; the slots that were written."""
        found = self._placed(batch).groupBy(SLOT).agg(F.max(F.col(self.key).isNull()).alias("nulls")).collect()  # `slots` rows at most
        touched = sorted(r[SLOT] for r in found)
        if touched:
            out = self.merged(batch, touched, any(r["nulls"] for r in found)).select(*self.columns, SLOT)
            # Spark shuffles both sides of a join again where buckets are fewer than its shuffle partitions
            with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.shuffle.partitions": str(self.buckets)}):
                out.write.insertInto(self.name, overwrite=True)
            self.spark.catalog.refreshTable(self.name)
        return touched

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
