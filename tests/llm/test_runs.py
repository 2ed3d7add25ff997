"""Operator 11 against runs by their definition, and odd rows."""

import random

import numpy as np
import pytest

from beliefmill.llm import queries, runs

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lyndon_by_suffixes(t):
    out = []
    for i in range(len(t)):
        j = i + 1
        while j < len(t) and t[j:] > t[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_definition(t, least, exponent):
    found = {}
    for q in range(1, len(t) // exponent + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(rng, n, symbols):
    t = [rng.randrange(symbols) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n + 1), rng.randrange(1, 12)
        t[a:a] = t[a:a + p] * rng.randrange(3, 9)
    return t


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(400):
        t = planted(rng, rng.randrange(30), rng.randrange(1, 4))
        assert runs.lyndon_array(t).tolist() == lyndon_by_suffixes(t)
    for t in ([], [5], [0] * 500, [0, 1] * 300, list(range(300)), list(range(300, 0, -1))):
        assert runs.lyndon_array(t).tolist() == lyndon_by_suffixes(t)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (3, 3), (10, 5), (40, 4)])
def test_runs_of_words(least, exponent):
    """All runs, with and without the search for repeated stretches, also where several texts are looked at together."""
    rng = random.Random(least)
    for _ in range(150):
        texts = [planted(rng, rng.randrange(60), rng.randrange(1, 5)) for _ in range(3)]
        want = [runs_by_definition(t, least, exponent) for t in texts]
        assert [runs.runs_of(np.array(t, np.int64), least, exponent) for t in texts] == want
        assert runs.document_runs([[b"%d" % c for c in t] for t in texts], least, exponent) == want
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int64), 6, 2)


def test_documents(spark):
    rng = random.Random(7)
    texts = [" ".join("wxyz"[c] for c in planted(rng, 80, 4)) for _ in range(30)]
    long = " ".join(str(rng.randrange(10**6)) for _ in range(300_000))
    texts += [None, "", " \t\n\r\x0b\f ", "na " * 400, "é É " * 9, "a b " * 7, long + " " + "p q r " * 50 + long]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[4], None, None, 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "runs", "collapsed", "n_words", "best", "h", "w", "a", "p", "start", "length"):
        df = df.withColumn(c, df.source)
    got = sorted(map(tuple, runs.periodic_runs(df).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        found = [(len(words) // 2 - 75, 150, 3)] if len(words) > 10**5 else runs_by_definition(words, 6, 4)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(words), found, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in got] == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    plan = queries.planted_runs(df)
    assert plan.where("doc_id is null or text is null or text = ''").count() == 4 and plan.count() == len(rows)
