"""JSON of any shape."""

import json
import math
import random

from pyspark.sql import functions as F

from beliefmill.functions import variants

ODD = ["a", "0.12345", 'q"1.55555"', "\\", "\\\" 2.345", "1e-5", "ключ 3.14159", "{[,]}", "-", "\\\\"]


def made(rng, depth=0):
    kind = rng.randrange(9 if depth < 6 else 6)
    if kind > 6:
        return {rng.choice(ODD) + str(i): made(rng, depth + 1) for i in range(rng.randrange(1, 4))}
    return [rng.uniform(-9, 9), rng.randrange(-99, 99), rng.choice(ODD), None, True, rng.random() * 10 ** rng.randrange(-6, 6), [made(rng, depth + 1) for _ in range(rng.randrange(1, 4))] if depth < 6 else 1][kind]


def by_rule(x):
    if isinstance(x, float):
        return math.floor(x * 100 + 0.5) / 100
    return {k: by_rule(v) for k, v in x.items()} if isinstance(x, dict) else [by_rule(v) for v in x] if isinstance(x, list) else x


def leaves(x, path=()):
    pairs = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
    return [((*path,), x)] if pairs is None else [leaf for k, v in pairs for leaf in leaves(v, (*path, str(k)))]


def test_rounding_touches_floats_only(spark):
    rng = random.Random(4)
    texts = [json.dumps(made(rng), indent=rng.choice((None, 1)), ensure_ascii=rng.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "1.005", '"1.005"', '{"x": "' + '\\"' * 20_000 + '", "y": 0.126}'])), "i int, t string")
    got = {r.i: r.g for r in df.select("i", variants.rounded_json(F.col("t")).alias("g")).collect()}
    for i, t in enumerate(texts):
        assert json.loads(got[i]) == by_rule(json.loads(t))
        if not any(isinstance(v, float) for _, v in leaves(json.loads(t))):
            assert got[i] == t
    assert [got[300], got[301], got[302], got[303]] == [None, "", "1.0" if math.floor(100.5 + 0.5 - 1e-9) < 101 and 1.005 * 100 + 0.5 < 101 else "1.01", '"1.005"'] and got[304].endswith('"y": 0.13}')


def test_leaves_of_any_depth(spark):
    rng = random.Random(5)
    values = [made(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, "no json"), (102, "{}"), (103, "[[], {}]"), (104, '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 7}}}}}}}')], "i int, t string")
    got = sorted((r.i, tuple(r.path), r.value is None) for r in variants.json_leaves(df, "t").collect())
    want = [(i, p, v is None) for i, x in enumerate(values) for p, v in leaves(x)] + [(104, tuple("abcdefg"), False)]
    assert got == sorted(want)
    texts = {(r.i, tuple(r.path)): r.value for r in variants.json_leaves(df, "t").collect()}
    assert all(texts[i, p] == v for i, x in enumerate(values) for p, v in leaves(x) if isinstance(v, str)) and texts[104, tuple("abcdefg")] == "7"


def test_multi_joint_tables_of_any_number_of_parents(spark):
    from beliefmill.operators import extract

    reply = {"multi_joints": [{"child": "c", "parents": ["a", "b"], "table": {"a=x": {"b=1": {"y": 0.25, "n": "0.75"}, "z=1": {"y": 1}}, "a=w": {"b=2": {"y": None, "n": "many"}}, "a=k": 3}},
                              {"child": "d", "parents": ["a", "b", "e"], "table": {"a=x": {"b=1": {"e=q=r": {"y": 0.5}}, "b=2": {"y": 0.1}}}}]}
    replies = spark.createDataFrame([("n", json.dumps(reply), "ok")], "bn_id string, raw string, status string")
    got = sorted(map(repr, ((r.child, r.combo, r.child_state, r.p) for r in extract.parse_multi_joints(replies).collect())))
    want = [("c", ["x", "1"], "y", 0.25), ("c", ["x", "1"], "n", 0.75), ("c", ["w", "2"], "y", None), ("c", ["w", "2"], "n", None), ("d", ["x", "1", "q=r"], "y", 0.5)]
    assert got == sorted(map(repr, want))
