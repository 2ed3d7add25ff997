"""Mixing sources to target weights: hash-threshold histograms.

Sums of sizes by source and hash bucket locate, for each source, the hash below which its documents
fill the budget. Only the bucket on the boundary is opened again, twelve bits at a time, so nothing is
sorted and a smaller budget always takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Bits of the hash that one histogram opens, and all bits of it (15 hexadecimal digits).
STEP_BITS, ALL_BITS = 12, 60
#: Source tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a hash of the id; of the text where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with weight and target for each source.

    Sources go by code point, null last, and their weights repeat in that order. They share `share`
    times the sum of all sizes by weight; no target passes `most` times its source's size, and what is
    above is shared again. The fixed point has one level: target = least(cap, level * weight), found
    here in one pass over the sources by cap / weight. A source of size 0 gets target 0. One row a
    source goes through one task.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "budget": F.lit(float(share)) * F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("budget") - F.col("before")) / F.col("rest")
    ranked = ranked.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("before", level.alias("level")))).over(everything))
    target = F.coalesce(F.least("cap", F.col("level.level") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", "rank", F.round(target, 6).alias("target"))


def mix_limits(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source: named, source_size, target, full, threshold, from sized (source, size, key)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(source_targets(totals, weights, share, most), "mix-sources")
    small = (lambda df: F.broadcast(df)) if sources.count() <= BROADCAST_ROWS else (lambda df: df)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("full", full.cast("long"))
    ranks = small(sources.select("source", "rank"))
    rows = sized.join(ranks, sized["source"].eqNullSafe(ranks["source"])).select("rank", "key", "size")
    edge = sources.select("rank", F.lit(0).cast("long").alias("low"), (F.col("target") - F.col("full") * F.col("source_size")).alias("left"))
    done = None
    for used in range(0, ALL_BITS, STEP_BITS):
        shift = ALL_BITS - used - STEP_BITS
        inside = rows.join(small(edge), "rank").where(F.shiftright("key", shift + STEP_BITS) == F.shiftright("low", shift + STEP_BITS))
        bucket = F.shiftleft(F.shiftright("key", shift), shift)
        counts = inside.groupBy("rank", "left", bucket.alias("low")).agg(F.sum("size").alias("sum"), F.min("key").alias("first"), F.max("key").alias("last"))
        upto = F.sum("sum").over(Window.partitionBy("rank").orderBy("low"))
        counts = counts.withColumn("upto", upto)
        # the first bucket that passes the budget; a source with none takes all
        crossed = counts.where("upto > left").groupBy("rank").agg(F.min_by(F.struct("low", (F.col("left") - F.col("upto") + F.col("sum")).alias("left"), "sum", "first", "last"), "low").alias("e"))
        crossed = staged(crossed.select("rank", "e.*"), "mix-edge")
        one = crossed.where("first = last").select("rank", F.when(F.col("left") * 2 >= F.col("sum"), F.col("last") + 1).otherwise(F.col("first")).alias("threshold"))
        done = one if done is None else done.union(one)
        edge = crossed.where("first < last").select("rank", "low", "left")
        if edge.isEmpty():
            break
    return small(sources.join(done, "rank", "left").select(
        F.col("source").alias("named"), "source_size", "target", "full", F.coalesce("threshold", F.lit(1 << ALL_BITS)).alias("threshold")))


def copies(limits: DataFrame, key: Column) -> Column:
    """How many times a document is taken: `full` times, and once more below the threshold."""
    more = F.when((key < limits["threshold"]) & (limits["target"] > limits["full"] * limits["source_size"]), 1).otherwise(0)
    return limits["full"] + more


def sizes_and_keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    text = docs[text_col].cast("string")
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"), document_key(docs[id_col], text, seed).alias("key"))
    return staged(sized, "mix-sized")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row a row of docs: doc_id, source, size, key, source_size, target, copies, taken.

    size counts the words of the text (null or empty: 0). A source whose target is f times its size and
    something more takes every document f times, and once more those whose key lies below the source's
    threshold. Documents are taken whole; the threshold is the one nearest to the budget, so the sum
    taken misses the target by at most half of one document (of one group of rows that share a key: a
    repeated row has its twin's key and is taken with it). Keys depend on the id alone, so a rerun
    agrees. Null ids are hashed by text. An empty table gives an empty result; extra columns are ignored.
    """
    sized = sizes_and_keys(docs, id_col, source_col, text_col, seed)
    limits = mix_limits(sized, weights, share, most)
    out = sized.join(limits, sized["source"].eqNullSafe(limits["named"]))
    n = copies(limits, sized["key"])
    return out.select("doc_id", "source", "size", "key", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of docs, all columns, each as often as mix_sources takes it; texts don't move."""
    limits = mix_limits(sizes_and_keys(docs, id_col, source_col, text_col, seed), weights, share, most)
    rows = docs.join(limits, docs[source_col].cast("string").eqNullSafe(limits["named"]))
    n = copies(limits, document_key(docs[id_col], docs[text_col].cast("string"), seed))
    each = F.explode(F.array_repeat(F.lit(1), n.cast("int")))
    columns = [docs[c] for c in docs.columns]
    return rows.select(*columns, each.alias("taken once more")).select(*docs.columns)
