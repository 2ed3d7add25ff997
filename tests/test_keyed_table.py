"""Upserts that touch the slots of their keys only."""

import os
import re

import pytest
from pyspark.sql import functions as F

from beliefmill.operators.keyed_table import SLOT, KeyedTable, settings


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit("old "), "id").alias("v"))
    t = KeyedTable(spark, "id", slots=50, buckets=4, path=str(tmp_path / "t")).create(rows)
    yield t
    t.drop()


def test_only_the_slots_of_the_batch_are_written(spark, table):
    before = files(table.path)
    keys = [3, 4, 19_999, 50_000]
    batch = spark.createDataFrame([(k, f"new {k}") for k in [*keys, 3]], "id bigint, v string")
    touched = table.upsert(batch)
    after = files(table.path)
    slots = {int(re.search(rf"{SLOT}=(\d+)", f)[1]) for f in before.keys() ^ after.keys() | {f for f in before.keys() & after.keys() if before[f] != after[f]}}
    assert slots == set(touched) and 1 <= len(touched) <= 4
    got = {r.id: r.v for r in table.read().collect()}
    assert table.read().count() == 20_001 and got == {i: f"old {i}" for i in range(20_000)} | {k: f"new {k}" for k in keys}
    table.upsert(batch.limit(0))
    assert files(table.path) == after


def test_plan_reads_pruned_buckets_without_an_exchange(spark, table):
    batch = spark.createDataFrame([(i, "x") for i in range(200)], "id bigint, v string")
    touched = sorted(r[0] for r in batch.select(table.slot(F.col("id"))).distinct().collect())[:7]
    with settings(spark, {"spark.sql.shuffle.partitions": "4"}):
        plan = table.merged(batch, touched)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    assert "PartitionFilters: [key_slot" in lines[at] and "SelectedBucketsCount: 4 out of 4" in lines[at]
    join = max(i for i in range(at) if "Join" in lines[i])
    assert not any("Exchange" in line for line in lines[join:at + 1]) and "Exchange" in "".join(lines[at:])


def test_failed_batch_changes_nothing(spark, table):
    before = files(table.path)
    bad = spark.range(40).select("id", F.when(F.col("id") == 20, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="stop"):
        table.upsert(bad)
    assert files(table.path) == before and table.read().where("v = 'x'").count() == 0


def test_null_and_text_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "k string, v int")
    t = KeyedTable(spark, "k", slots=5, buckets=2, path=str(tmp_path / "n")).create(rows)
    t.upsert(spark.createDataFrame([(5, None), (6, "b")], "v int, k string"))
    assert sorted(map(tuple, t.read().collect()), key=repr) == sorted([("a", 1), (None, 5), ("", 3), ("b", 6)], key=repr)
    t.drop()
    assert not os.path.exists(tmp_path / "n")
