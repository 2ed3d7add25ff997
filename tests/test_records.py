"""Caps without a sort, counts of the pass that writes, and repeated replies."""

import hashlib

import pytest
from pyspark.sql import functions as F

from beliefmill.functions.staging import written_counting
from beliefmill.operators import evaluation_run, records


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 2999, 3000, 4000])
def test_first_by_hash(spark, n):
    """The same rows as a sort by hash gives; many rows of one key, which share a place, fill up what is left."""
    keys = [f"k{i}" for i in range(1500)] + ["hot"] * 1500
    got = sorted(r.k for r in records.first_by_hash(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int"), "k", n).collect())
    assert got == sorted(sorted(keys, key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())[:n])


def test_counting_pass(spark):
    table, n = written_counting(spark.range(100), "t", {"even": F.col("id") % 2 == 0, "large": F.col("id") > 89, "none": F.lit(False)})
    assert n == {"even": 50, "large": 10, "none": 0} and table.count() == 100


def test_the_last_of_repeated_replies_counts(spark):
    rows = [("s", "nodes", "", '{"nodes": ["z"]}', 1), ("s", "nodes", "", '{"nodes": ["b"]}', 2), ("t", "nodes", "", '{"nodes": ["c"]}', 5), ("t", "nodes", "", "no", 4)]
    df = spark.createDataFrame(rows, "sg_id string, step string, key string, raw string, pos int")
    assert sorted((r.sg_id, r.j.nodes) for r in evaluation_run.parsed(df, "nodes", "nodes array<string>").collect()) == [("s", ["b"]), ("t", ["c"])]
    pair = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "parent string, child string")
    assert pair.select(evaluation_run.edge_key("parent", "child")).distinct().count() == 2
