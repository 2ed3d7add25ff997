"""Connected subsets as bits: counts and draws of networks too large to list by hand, against brute force."""

import itertools
import random
from collections import Counter

import pytest

from beliefmill.operators import graph


def network(spark, bn_id, names, pairs):
    nodes = spark.createDataFrame([(bn_id, i, n) for i, n in enumerate(names)], "bn_id string, node_pos int, node string")
    edges = spark.createDataFrame([(bn_id, i, a, b) for i, (a, b) in enumerate(pairs)], "bn_id string, edge_pos int, parent string, child string")
    return edges, nodes


def brute(names, pairs, smallest, largest):
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
    level, out = {frozenset([n]) for n in names}, set()
    for size in range(1, largest + 1):
        out |= {s for s in level if size >= smallest}
        level = {s | {x} for s in level for n in s for x in near[n] - s}
    return {tuple(sorted(s)) for s in out}


@pytest.fixture(scope="module")
def twenty():
    rng = random.Random(2)
    names = [f"n{i}" for i in range(20)]
    pairs = [(names[i], names[j]) for i, j in itertools.combinations(range(20), 2) if rng.random() < 0.14]
    return names, pairs, brute(names, pairs, 3, 7)


def test_counts_of_twenty_nodes(spark, twenty):
    names, pairs, want = twenty
    edges, nodes = network(spark, "a", names, [*pairs, pairs[0], (names[3], names[3])])
    more = network(spark, "b", ["x", "y", "z"], [("x", "y")])
    edges, nodes = edges.union(more[0]), nodes.union(more[1])
    counts = {(r.bn_id, r["size"]): r.n for r in graph.subset_counts(edges, nodes, 2, 7).collect()}
    assert counts.pop(("b", 2)) == 1
    assert {k: n for k, n in counts.items() if k[1] > 2} == {("a", k): n for k, n in Counter(map(len, want)).items()} and len(want) > 3000
    listed = [tuple(r.members) for r in graph.connected_subsets(edges, nodes, 3, 7).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == want
    plan = graph.connected_subsets(edges, nodes, 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") >= 6 and "Deduplicate" not in plan


def test_draws(spark, twenty):
    """All sets where as many are asked for, as many different ones as asked for else, and each as often as any other."""
    names, pairs, want = twenty
    edges, nodes = network(spark, "a", names, pairs)
    some = [tuple(r.members) for r in graph.drawn_subsets(edges, nodes, 500, 3, 7).collect()]
    assert len(some) == len(set(some)) == 500 and set(some) <= want
    share = Counter(map(len, some))
    assert all(abs(share[k] - 500 * n / len(want)) < 60 for k, n in Counter(map(len, want)).items())
    small = [(f"m{i}", ["p", "q", "r", "s", "t"], [("p", "q"), ("q", "r"), ("r", "s"), ("q", "s"), ("s", "t")]) for i in range(300)]
    parts = [network(spark, *x) for x in small[:1]]
    ids = spark.createDataFrame([(x[0],) for x in small], "bn_id string")
    e, n = (p.drop("bn_id").crossJoin(ids).select(*p.columns) for p in parts[0])
    every = brute(*small[0][1:], 2, 4)
    got = [(r.bn_id, tuple(r.members)) for r in graph.drawn_subsets(e, n, 3, 2, 4).collect()]
    assert len(got) == len(set(got)) == 900
    often = Counter(m for _, m in got)
    assert set(often) == every and all(0.6 < v * len(every) / 900 < 1.4 for v in often.values())
    whole = [(r.bn_id, tuple(r.members)) for r in graph.drawn_subsets(e, n, 1000, 2, 4).collect()]
    assert len(whole) == len(set(whole)) and {m for _, m in whole} == every and len(whole) == 300 * len(every)


def test_many_nodes(spark):
    """63 nodes are a long's bits but one; 64 are an error. Networks without edges or nodes give what they have."""
    names = [f"n{i:02d}" for i in range(63)]
    edges, nodes = network(spark, "a", names, list(itertools.pairwise(names)))
    counts = {r["size"]: r.n for r in graph.subset_counts(edges, nodes, 1, 5).collect()}
    assert counts == {k: 64 - k for k in range(1, 6)}
    big = network(spark, "a", [*names, "x"], [])
    with pytest.raises(Exception, match="more than 63 nodes"):
        graph.subset_counts(*big, 1, 5).collect()
    none = network(spark, "a", ["p", "q"], [])
    assert sorted(r.members for r in graph.connected_subsets(*none, 1, 3).collect()) == [["p"], ["q"]]
    assert graph.drawn_subsets(*none, 3, 2, 3).count() == 0 and graph.drawn_subsets(none[0], none[1].limit(0), 3).count() == 0
