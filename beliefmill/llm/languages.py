"""Language identification: a text's most frequent n-grams against each language's, by out-of-place distance of ranks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tidy

#: N-grams of a profile, and of a text, that are compared.
PROFILE = 400
#: Languages whose profiles are told to every task: at most 16 MB.
LANGUAGES = 5000
#: Letters that are counted at a time.
PIECE = 400_000
BLANK = 32
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_keys(points: np.ndarray, done: int) -> np.ndarray:
    """The 1-, 2- and 3-grams that end after the first `done` code points, as numbers of up to three 21-bit code points.

    Points that aren't letters are blanks, which pad words: no gram goes over a blank, and none is blanks only.
    Numbers ascend by length, then by code points.
    """
    c = np.where(letters()[points], points, BLANK).astype(np.int64)
    one = c[done:]
    out = [one[one != BLANK]]
    if len(c) > 1:
        a, b = c[max(done, 1) - 1:-1], c[max(done, 1):]
        some = (a != BLANK) | (b != BLANK)
        out.append((a[some] << 21) | b[some])
    if len(c) > 2:
        a, b, d = c[max(done, 2) - 2:-2], c[max(done, 2) - 1:-1], c[max(done, 2):]
        some = b != BLANK
        out.append((a[some] << 42) | (b[some] << 21) | d[some])
    return np.concatenate(out)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) with the counts of a key added up; keys ascend."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text in lower case, in pieces that overlap by two characters."""
    text = f" {text.lower()} "
    keys, counts = [], []
    for at in range(0, len(text), PIECE):
        early = min(at, 2)
        points = np.frombuffer(text[at - early:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        k, n = np.unique(gram_keys(points, early), return_counts=True)
        keys.append(k)
        counts.append(n)
        if len(keys) > 20:
            k, n = merged(keys, counts)
            keys, counts = [k], [n]
    return merged(keys, counts)


def gram_counts(batches):
    """(lang, gram, n) of (lang, text): sums over a task, sent on whenever a million are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts: dict[str, list[str]] = {}
    size = 0

    def close():
        for lang, some in texts.items():
            held.setdefault(lang, []).append(text_grams(" ".join(some)))
            if len(held[lang]) > 20:
                held[lang] = [merged(*map(list, zip(*held[lang], strict=True)))]
        texts.clear()

    def rows():
        for lang, some in held.items():
            k, n = merged(*map(list, zip(*some, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py()
            texts.setdefault(lang, []).append(t)
            size += len(t)
            if size > PIECE:
                close()
                size = 0
                if sum(len(k) for some in held.values() for k, _ in some) > 1_000_000:
                    yield from rows()
    close()
    yield from rows()


@dataclass
class Profiles:
    """languages, ascending; grams of any profile, ascending; rank[g, l] of a gram in a language, PROFILE where it isn't there."""

    languages: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE, most: int = LANGUAGES) -> Profiles:
    """The `size` most frequent n-grams of each language, counted over all rows that have a language and a text.

    Equal counts come by n-gram. Only ranks reach the driver, `size` rows a language; more than `most`
    languages are an error.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(tidy(gram_counts), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranks = staged(counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank"), "language-ranks")
    names = [r["lang"] for r in ranks.select("lang").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    found = ranks.toPandas()  # size rows a language
    languages = sorted(names)
    grams, g = np.unique(found["gram"].to_numpy(np.int64), return_inverse=True)
    rank = np.full((len(grams), len(languages)), size, np.int32)
    rank[g, np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object))] = found["rank"]
    return Profiles(languages, grams, rank, size)


def distances(keys: np.ndarray, counts: np.ndarray, p: Profiles) -> tuple[np.ndarray, int]:
    """(out-of-place distance to each language, the largest possible) of a text's n-grams."""
    own = keys[np.lexsort((keys, -counts))[:p.size]]
    at = np.minimum(np.searchsorted(p.grams, own), len(p.grams) - 1)
    known = p.grams[at] == own
    places = np.flatnonzero(known)
    there = p.rank[at[known]]
    d = np.where(there < p.size, np.abs(there - places[:, None]), p.size).sum(axis=0, dtype=np.int64)
    return d + p.size * int((~known).sum()), p.size * len(own)


def predict_rows(profiles):
    """(id, lang, score) of (id, text)."""

    def run(batches):
        p = profiles.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                lang, score = "und", 0.0
                keys, counts = text_grams(text.as_py() or "")
                if len(keys) and p.languages:
                    d, most = distances(keys, counts, p)
                    best = int(d.argmin())
                    lang, score = p.languages[best], 1 - int(d[best]) / most
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) of each row: the language at the smallest distance, and 1 less its share of the largest one.

    Texts are whole and in lower case. Equal distances go to the language that comes first by code point.
    Null texts and texts without a letter are `und` with score 0, as are all where nothing was learned.
    Null ids and repeated rows give a row each; empty tables give no rows; extra columns are ignored. A
    document is worked on in one task, in pieces.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return rows.mapInArrow(tidy(predict_rows(shared)), f"id {kind}, lang string, score double")
