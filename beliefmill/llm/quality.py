"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text and one of all raw text, give every document
a log ratio; the documents with the largest ratio plus Gumbel noise are the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged, tidy

#: Hash buckets of the n-gram models, and what is added to each bucket's count.
BUCKETS, SMOOTH = 1 << 15, 1.0
#: Labelled rows that the target model and the threshold are fitted on, at most.
LABELLED = 20_000
#: A wrongly dropped target document weighs so many wrongly kept others when the threshold is set.
DROP_COST = 5.0
#: Bins of one histogram in the selection of the k-th largest key.
BINS = 4096
#: Tokens that a worker remembers.
REMEMBER = 100_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode())
        return h


def ngrams(text: str | None, seen: Tokens) -> np.ndarray:
    """Buckets of all words, marks and pairs of neighbours of a whole text; two equal neighbours share one bucket."""
    found = _TOKEN.findall(text) if text else []
    h = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
    two = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    two[h[:-1] == h[1:]] = 7
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64)


def count_rows(batches):
    """(bucket, raw, target) of a task's rows (text, is_target)."""
    seen, counts = Tokens(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            got = np.bincount(ngrams(text.as_py(), seen), minlength=BUCKETS)
            counts[0] += got
            if target:
                counts[1] += got
    full = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[0][full]), pa.array(counts[1][full])], names=["bucket", "raw", "target"])


def score_rows(weights):
    """(id, k, noise, score) of (id, k, noise, text); score is the log ratio of the whole text, rounded to 6 places."""

    def run(batches):
        seen, w = Tokens(), weights.value
        for batch in batches:
            scores = [round(float(w[ngrams(t.as_py(), seen)].sum()), 6) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], names=["id", "k", "noise", "score"])

    return run


def gumbel(doc_id: Column, k: Column, seed: int) -> Column:
    """Gumbel noise that follows from the id; from the text's hash where there is no id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), k.cast("string")), F.lit(seed)), 12)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))))


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a column of finite doubles, by histograms of BINS rows; nothing is sorted."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / BINS
        if width <= abs(high) * 1e-15:
            break
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        bin_ = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        counts = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()  # BINS rows at most
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["lo"], r["hi"]
        if k == r["n"]:
            return low
        if k == 1:
            return high
    return low


@dataclass
class Model:
    weights: np.ndarray
    threshold: float


def labelled_sample(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, good): at most `most` ids that have a quality, chosen by hash; ids with several labels are good if all are."""
    named = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min("quality") > 0).alias("good"))
    return named.orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> Model:
    """The raw model counts every document; target model and threshold use at most `most` labelled rows.

    Half of the labelled rows (by hash) train the target model, the other half set the threshold, where
    dropping target documents costs DROP_COST times as much as keeping others; the threshold is the
    middle of the gap it is found in. Without labels, or with labels of one kind, nothing is rejected.
    """
    spark = docs.sparkSession
    sample = staged(labelled_sample(labels, id_col, most), "quality-sample")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    train = F.broadcast(sample.where("good and pmod(xxhash64(id, 1), 2) = 0").select("id", F.lit(True).alias("is_target")))  # LABELLED rows at most
    counted = rows.join(train, "id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = np.zeros((2, BUCKETS))
    for r in counted.mapInArrow(tidy(count_rows), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toLocalIterator():  # BUCKETS rows
        counts[:, r["bucket"]] = r["raw"], r["target"]
    p = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    weights = np.log(p[1]) - np.log(p[0])
    if not counts[1].sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    held = F.broadcast(sample.where("not (good and pmod(xxhash64(id, 1), 2) = 0)"))
    shared = spark.sparkContext.broadcast(weights)
    kind = rows.schema["id"].dataType.simpleString()
    judged = rows.join(held, "id").select("id", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("noise"), "text").mapInArrow(tidy(score_rows(shared)), f"id {kind}, k bigint, noise double, score double")
    judged = judged.groupBy("id").agg(F.min("score").alias("score")).join(held, "id").select("score", "good").collect()  # LABELLED rows at most
    good, bad = (np.sort([r["score"] for r in judged if r["good"] is flag]) for flag in (True, False))
    if not len(good) or not len(bad):
        return Model(weights, -np.inf)
    cuts = np.unique(np.concatenate([good, bad]))
    cost = DROP_COST * np.searchsorted(good, cuts) / len(good) + (len(bad) - np.searchsorted(bad, cuts)) / len(bad)
    best = int(np.argmin(cost))
    below = cuts[best - 1] if best else cuts[0] - 1
    return Model(weights, float((cuts[best] + below) / 2) if cost[best] <= 1 else -np.inf)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """(id, k, noise, score, key) of each row: the log ratio and the ratio with noise."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    rows = rows.select("id", "k", gumbel(F.col("id"), F.col("k"), seed).alias("noise"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    out = rows.mapInArrow(tidy(score_rows(shared)), f"id {kind}, k bigint, noise double, score double")
    return out.withColumn("key", F.col("score") + F.col("noise"))


def select(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, size: int | None, seed: int) -> tuple[Model, DataFrame, float]:
    """(model, scores, smallest key of the sample)."""
    model = fit(docs, labels, id_col, text_col, most)
    scores = staged(scored(docs, model, id_col, text_col, seed), "quality-scores")
    if size is None:
        size = scores.where(F.col("score") >= F.lit(model.threshold)).count()
    return model, scores, kth_largest(scores, "key", size)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, size: int | None = None, seed: int = 3) -> DataFrame:
    """The sample: (id, k, score, key) of the `size` documents with the largest log ratio plus Gumbel noise.

    By default size is the number of documents whose ratio passes the model's threshold. Texts are
    whole; null and empty texts have ratio 0. Rows of one id have one noise; rows that tie with the last
    one of the sample are in it too. Null ids are kept and draw their noise by text. An empty table gives
    an empty sample; extra columns are ignored.
    """
    _, scores, least = select(docs, labels, id_col, text_col, most, size, seed)
    return scores.where(F.col("key") >= F.lit(least)).select("id", "k", "score", "key")


def sampled_rows(weights, least: float, text_at: int):
    """Of rows whose last column is the noise, those in the sample, without it."""

    def run(batches):
        seen, w = Tokens(), weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # small pieces, as whole rows go back
                some = batch.slice(at, 1000)
                scores = [round(float(w[ngrams(t.as_py(), seen)].sum()), 6) for t in some.column(text_at)]
                keep = np.array(scores) + some.column(some.num_columns - 1).to_numpy() >= least
                yield pa.RecordBatch.from_arrays(some.columns[:-1], schema=pa.schema(list(some.schema)[:-1])).filter(pa.array(keep))

    return run


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, size: int | None = None, seed: int = 3) -> DataFrame:
    """The rows of docs, all columns, that are in the sample; the texts are scored once more where they are, so none moves."""
    model, _, least = select(docs, labels, id_col, text_col, most, size, seed)
    if least == -np.inf:
        return docs
    noise = gumbel(docs[id_col], F.xxhash64(docs[text_col].cast("string")), seed)
    rows = docs.select(*(docs[c] for c in docs.columns), noise.alias("sampling noise"))
    return rows.mapInArrow(tidy(sampled_rows(docs.sparkSession.sparkContext.broadcast(model.weights), least, docs.columns.index(text_col))), docs.schema)
