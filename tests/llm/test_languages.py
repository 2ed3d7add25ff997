"""Operator 13 against plain counting, and its accuracy on rows that it hasn't learned from."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beliefmill.llm import languages, queries

LARGE = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = {"en": "the quick brown fox and the lazy dog of the house", "de": "der schnelle braune Fuchs und der faule Hund über das Haus", "fr": "le renard brun et rapide saute par-dessus le chien, là-bas"}


def grams(text):
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    found = [t[i:i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    return Counter(g for g in found if g.strip() and (len(g) < 3 or g[1] != " "))


def ranked(counts, size):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size])}


def by_counting(text, profiles, size):
    own = ranked(grams(text or ""), size)
    if not own or not profiles:
        return "und", 0.0
    d = {lang: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
    best = min(d, key=lambda lang: (d[lang], lang))
    return best, 1 - d[best] / (size * len(own))


@pytest.mark.parametrize("piece", [1, 2, 7, 400_000])
def test_pieces(monkeypatch, piece):
    """Cut into pieces of a few letters, a text has the counts of the whole text."""
    monkeypatch.setattr(languages, "PIECE", piece)
    for t in (*TEXTS.values(), "", " ", "a", "ab  c,d", "İstanbul ΣΑΣ", "x" * 100):
        keys, counts = languages.text_grams(t)
        text = lambda k: "".join(chr(c) for c in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if c)
        assert Counter(dict(zip(map(text, keys.tolist()), counts.tolist(), strict=True))) == grams(t)


@pytest.mark.parametrize("size", [20, 400])
def test_against_counting(spark, size):
    rows = [(i, t * (1 + i % 3), lang) for i, (lang, t) in enumerate(list(TEXTS.items()) * 4)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 -- \n", "fr"), (53, "Straße ÉTÉ İstanbul Σίσυφος 漢字", None), (54, "漢字かな " * 30, "ja"), (None, "house of the dog", None), (3, rows[3][1], "en"), (55, "x" * 5000, None), (56, "\U0001d4d0́ a", None)]
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], SCHEMA)
    for c in ("id", "gram", "n", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    counts = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: ranked(c, size) for lang, c in counts.items() if c}
    learned = languages.learn(df, size=size)
    assert learned.languages == sorted(profiles)
    got = sorted(map(tuple, languages.predict(df, learned).collect()), key=repr)
    assert got == sorted(((i, *by_counting(t, profiles, size)) for i, t, _ in rows), key=repr)
    none = languages.learn(df.limit(0), size=size)
    assert {r.lang for r in languages.predict(df, none).collect()} == {"und"} and languages.predict(df.limit(0), learned).count() == 0
    with pytest.raises(ValueError):
        languages.learn(df, most=2)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_held_out_accuracy(spark):
    found = queries.op13_language_id(spark, LARGE).where("held_out").join(spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.n > 1500 and r.right >= 0.995 and 0 <= r.low <= r.high <= 1
