"""Networks with many nodes."""

import random
import time

import numpy as np
import pytest

from beliefmill.operators import graph, wide


def greedy(pairs):
    down, out = {}, []
    for p, c in pairs:
        seen, todo = {c}, [c]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out.append(p not in seen)
        if out[-1]:
            down.setdefault(p, set()).add(c)
    return out


def longest(names, pairs):
    level = dict.fromkeys(names, 0)
    for _ in names:
        moved = False
        for p, c in pairs:
            if level[c] < level[p] + 1:
                level[c], moved = level[p] + 1, True
        if not moved:
            return [level[n] for n in names]


def test_bit_sets_against_searches():
    rng = random.Random(3)
    for _ in range(200):
        names = [f"n{i}" for i in range(rng.randrange(1, 12))]
        pairs = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(40))]
        fits = wide.accepted(pairs)
        assert fits == greedy(pairs)
        kept = [p for p, f in zip(pairs, fits, strict=True) if f]
        assert wide.longest_paths(names, kept) == longest(names, kept)


@pytest.mark.parametrize("folded", [0, 64])
def test_a_thousand_nodes_beside_small_networks(spark, monkeypatch, folded):
    """The same edges and levels from folds and from bit sets, and from a network that no fold could hold."""
    monkeypatch.setattr(graph, "FOLDED", folded)
    rng = random.Random(folded)
    nets = {f"s{i}": ([f"n{k}" for k in range(6)], 10) for i in range(20)} | {"big": ([f"n{k}" for k in range(1000)], 3000)}
    nodes, edges, want, levels = [], [], [], []
    for bn, (names, n) in nets.items():
        pairs = [(rng.choice(names), rng.choice(names)) for _ in range(n)]
        nodes += [(bn, i, x) for i, x in enumerate(names)]
        edges += [(bn, i, *p) for i, p in enumerate(pairs)] + [(bn, n, names[0], "missing")]
        kept = [(bn, i, *p) for i, (p, f) in enumerate(zip(pairs, greedy(pairs), strict=True)) if f]
        want += kept
        levels += zip([bn] * len(names), names, longest(names, [k[2:] for k in kept]), strict=True)
    n = spark.createDataFrame(nodes, "bn_id string, node_pos int, node string")
    dag = graph.validate_dag(spark.createDataFrame(edges, "bn_id string, edge_pos int, parent string, child string"), n)
    assert sorted(map(tuple, dag.collect())) == sorted(want)
    assert sorted((r.bn_id, r.node, r.level) for r in graph.levels(dag, n).collect()) == sorted(levels)


@pytest.mark.parametrize("most", [0, 4096])
def test_numbers_against_bit_sets(monkeypatch, most):
    """Edges on no cycle, parts as bit sets, and parts in a kept order give what bit sets of the whole network give."""
    monkeypatch.setattr(wide, "BITS", most)
    rng = random.Random(most)
    for _ in range(300):
        n = rng.randrange(1, 14)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 40))]
        p, c = (np.array(x) for x in zip(*pairs, strict=True))
        fits = wide.accepted_numbers(n, p, c)
        assert fits.tolist() == wide.accepted(pairs)
        kept = [x for x, f in zip(pairs, fits, strict=True) if f]
        assert wide.waves(n, p[fits], c[fits]).tolist() == wide.longest_paths(list(range(n)), kept)


def test_a_network_of_a_hundred_thousand_nodes():
    """Time and memory grow with the edges: bit sets of these nodes would take 2 GB."""
    rng = np.random.default_rng(1)
    n, a, b = 100_000, rng.integers(0, 100_000, 400_000), rng.integers(0, 100_000, 400_000)
    p, c = np.minimum(a, b), np.maximum(a, b)
    p, c = np.append(p, n - 1), np.append(c, n - 1)  # a self loop
    began = time.process_time()
    assert (wide.accepted_numbers(n, p, c) == (p != c)).all()
    level = wide.waves(n, p[p != c], c[p != c])
    assert (level[p] < level[c])[p != c].all() and level.min() == 0
    assert time.process_time() - began < 20
