"""Operator 12 against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefmill.llm import rtree

SCHEMA = "vec_id bigint, embedding array<double>, label int, n int"


def whole(v, scale=256.0):
    x = [None if c is None else c * scale for c in v]
    return None if any(c is None or c != c or abs(c) == float("inf") for c in x) else [int(np.floor(c)) for c in x]


def brute(rows, anchor, positives=5, negatives=10):
    rows = [(i, whole(v), g) for i, v, g in rows if v is not None and g is not None and whole(v) is not None]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, q, g) in enumerate(rows):
        if not anchor(i):
            continue
        score = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j, h) for b, (j, v, h) in enumerate(rows) if b != a and len(v) == len(q)]
        for s, j, _ in sorted((r for r in score if r[2] == g), key=order)[:positives]:
            fit = [r for r in score if r[2] != g and Fraction(30, 100) * s <= r[0] <= Fraction(90, 100) * s]
            out += [(i, j, k + 1, r[1], s, r[0]) for k, r in enumerate(sorted(fit, key=order)[:negatives])]
    return sorted(out, key=repr)


def table(spark, rows):
    df = spark.createDataFrame([(i, v, g, 1) for i, v, g in rows], SCHEMA)
    for c in ("row", "id", "v", "dim", "low", "high", "score", "rank", "pack", "window", "is_anchor", "slab", "tile"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize(("pack", "directory"), [(40, 1000), (40, 0), (None, 1000)])
def test_against_all_pairs(spark, pack, directory):
    """Clusters, copies that are a third of the rows, ties, null ids, other lengths, repeated rows, and what takes no part."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(c) for c in centres[i % 6] + rng.standard_normal(8) * (0.3, 0.02)[i % 2]], i % 4) for i in range(300)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(150)]
    rows += [(20, rows[20][1], 0), (20, rows[20][1], 0), (None, rows[21][1], 1), (None, rows[22][1], 2), (30, rows[31][1], 2)]
    rows += [(2000, [1.0, 2.0], 1), (2010, [1.0, 2.5], 1), (2020, [0.6, 1.0], 2), (2030, [0.0] * 8, 1), (2040, None, 1), (2050, [1.0] * 8, None), (2060, [None] * 8, 1), (2070, [float("nan")] * 8, 1), (2080, [float("inf")] * 8, 1),
             (2090, [1e308] * 8, 1), (2100, [1e9] * 8, 7), (2110, [9e8] * 8, 7), (2120, [5e8] * 8, 8), (2130, [1e15] * 8, 9), (2140, [-1e15] * 8, 9), (2150, [], 1), (2160, [], 1), (2170, [], 2)]
    random.Random(1).shuffle(rows)
    got = rtree.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, pack=pack, directory=directory)
    want = brute(rows, lambda i: i is not None and i % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 500


def test_text_labels_and_empty_tables(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(60)]
    df = table(spark, rows)
    got = rtree.hard_negatives(df.withColumn("label", F.concat(F.lit("g"), "label")), F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, lambda i: i % 10 == 0)
    assert rtree.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert rtree.hard_negatives(df, F.lit(False)).count() == 0
    assert rtree.hard_negatives(df.withColumn("label", F.col("vec_id")), F.lit(True)).count() == 0


def test_boxes_prune():
    """Far leaves aren't opened: most boxes lie strictly below the kth score."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.floor(256 * (c + rng.standard_normal((500, 3)) * 0.05)) for c in rng.standard_normal((20, 3)) * 4])
    x = x[rtree.tile_order(x)]
    tree, seen, real = rtree.Tree(x), [], rtree.scores_of
    try:
        rtree.scores_of = lambda a, q, exact: seen.append(len(a)) or real(a, q, exact)
        n = np.arange(len(x))
        far = np.array([-2**63])
        got = list(rtree.best_first(tree, n, n, np.zeros(len(x), int), x[0], -1, 0, True, far, -1 - far, far, 5))
    finally:
        rtree.scores_of = real
    s = (x @ x[0]).astype(int)
    assert [r[2] for r in got] == sorted(n.tolist(), key=lambda i: (-s[i], i))[:5] and sum(seen) < len(x) / 4
