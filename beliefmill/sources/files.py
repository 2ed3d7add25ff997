"""Scans and sinks: JSON lines, corpus files, CSV."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import numbered
from .corpus_file import read_members
from .ledger import store


def existing(spark: SparkSession, *paths: str) -> None:
    """An error that names the first path that isn't there."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(path)


def write_corpus(records: DataFrame, about: DataFrame, path: str, key: str = "id", pos: str = "pos", text: str | None = None) -> None:
    """{"metadata": {…}, "bayesian_networks": {id: record, …}} as text, a record a line, by position.

    The files of the folder, one after another in name order, are one JSON object: ranges of positions
    make the tasks, and the head and the foot are the first and the last line. about: one row. text: a column
    that holds the whole record as JSON; else a record is all columns but the position.
    The lines are written beside the path and moved there when all are done, so a write that fails leaves
    what was there before, and nothing else.
    """
    names = [c for c in records.columns if c != pos]
    whole = F.col(text) if text else F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    body = records.select(F.col(pos).cast("long").alias("pos"), F.to_json(F.struct(F.col(key).cast("string").alias("k"))).alias("k"), whole.alias("v"))
    name = F.expr("substring(k, 6, length(k) - 6)")  # the quoted key of {"k":"…"}
    first = body.agg(F.min("pos")).first()[0]
    line = F.concat(F.when(F.col("pos") == first, F.lit("")).otherwise(F.lit(",")), name, F.lit(": "), "v")
    head = about.select(F.lit(-2).cast("long").alias("pos"), F.concat(F.lit('{"metadata": '), F.to_json(F.struct(*about.columns), {"ignoreNullFields": "false"}), F.lit(', "bayesian_networks": {')).alias("value"))
    foot = about.select(F.lit((1 << 62)).cast("long").alias("pos"), F.lit("}}").alias("value"))
    rows = head.unionByName(body.select("pos", line.alias("value"))).unionByName(foot)
    lines = rows.repartitionByRange("pos").sortWithinPartitions("pos").select("value")
    spark = records.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.writing")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lines.write.text(beside.toString())
        store.delete(at, True)
        if not store.rename(beside, at):
            raise OSError(f"{beside.toString()} can't be moved to {path}")
    finally:
        store.delete(beside, True)


def write_evaluation(tables, path: str) -> None:
    """results, aggregate and plots of an evaluation as JSON lines, each in its folder."""
    for name in ("results", "aggregate", "plots"):
        write_json_lines(getattr(tables, name), f"{path}/{name}", "overwrite")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema that is given, not inferred; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, record): the lines of files as they are written, from 0 in the order of files and lines; blank ones are skipped.

    A file is read in many blocks; a line's place is its file, its block and its number there.
    """
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = lines.where("trim(record) <> ''").select("record", F.struct("file", "block", "line").alias("place"))
    return numbered(placed, "place", "%d", "number").select((F.col("number").cast("long") - 1).alias("pos"), "record")


def write_lines(rows: DataFrame, path: str, pos: str = "pos", text: str = "record") -> None:
    """Texts as lines, by position over the files in name order."""
    rows.repartitionByRange(pos).sortWithinPartitions(pos).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_each(rows: DataFrame, path: str = "path", text: str = "text") -> int:
    """A file a row, at its path, and how many there are. A task that runs again writes the same files again."""

    def run(batches):
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, file = store(at)
                where.create_dir(file.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(file) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    return rows.select(path, text).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_corpus(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(bn_pos, id, record) of a {"bayesian_networks": {id: record}} file or folder, in its order; parsed with a schema, else text as it is written."""
    rows = read_members(spark, path)
    return rows if schema is None else rows.withColumn("record", F.from_json("record", schema))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def corpus_json(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, json) of each record, nulls kept; the parts of a corpus file, a line each."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """The named fields in order; fields that df lacks are empty, others are dropped."""
    df.select(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields)).write.mode(mode).option("header", True).csv(path)
