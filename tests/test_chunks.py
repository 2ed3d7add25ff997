"""Greedy chunks against the plain fold."""

import random

import numpy as np
import pytest

from beliefmill.operators import chunks


def folded(costs, budget):
    out, used, chunk = [], 0, 0
    for c in costs:
        if used > 0 and used + c > budget:
            chunk, used = chunk + 1, 0
        used += c
        out.append(chunk)
    return out


def test_jumps_and_last_starts():
    rng = random.Random(1)
    for _ in range(500):
        costs = [rng.choice((0, 0, 1, 2, 5, 30)) for _ in range(rng.randrange(1, 25))]
        budget = rng.choice((1, 4, 10, 100))
        to = chunks.jumps(np.concatenate([[7], 7 + np.cumsum(costs)]), budget)
        for i in range(len(costs)):
            own = folded(costs[i:], budget)
            assert to[i] == i + (own.index(1) if 1 in own else len(own))
        end, count = chunks.last_starts(to)
        for i in range(len(costs)):
            own = folded(costs[i:], budget)
            assert count[i] == own[-1] and end[i] == i + own.index(own[-1])


@pytest.mark.parametrize(("budget", "choices", "ranges"), [(10, (0, 1, 2, 5, 30), 16), (1000, (0, 1, 2), 16), (3, (0, 0, 0, 0, 9), 24), (10**6, (0, 1), 12), (50, (1, 7, 20), 1)])
def test_hot_keys_over_many_ranges(spark, budget, choices, ranges):
    """One key has most rows, some have a few, null is a key; chunks longer and shorter than a range, ranges of zeros."""
    rng = random.Random(budget)
    rows = [("hot", i, rng.choice(choices)) for i in range(2500)] + [(rng.choice(["a", "b", "c", "zz", None]), 10**6 + i, rng.choice(choices)) for i in range(400)]
    rows += [("zeros", i, 0) for i in range(300)] + [("late", i, 5 * (i == 299)) for i in range(300)] + [("null", i, None) for i in range(5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint, c int")
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(repr, map(tuple, chunks.greedy_chunk_rows(df, "k", "o", "c", budget).collect())))
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((o, c) for k, o, c in rows if k == key and c is not None)
        want += [(key, o, c, n) for (o, c), n in zip(own, folded([c for _, c in own], budget), strict=True)]
    assert got == sorted(map(repr, want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, o bigint, c int")
    assert chunks.greedy_chunk_rows(df, "k", "o", "c", 5).count() == 0
