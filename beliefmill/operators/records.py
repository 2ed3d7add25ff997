"""Corpora as records: numbering, merging, resuming, selecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.staging import written


def last_wins(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Of the rows of a key, the one with the largest position."""
    order = Window.partitionBy(*keys).orderBy(F.desc(pos))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def numbered(rows: DataFrame, pos: str, pattern: str = "bn_%05d", name: str = "new_id") -> DataFrame:
    """Sequential ids by position. Positions are counted within ranges and over ranges, so no task sorts all rows.

    The ranges are written before both branches read them, since they may be dealt otherwise a second time.
    """
    spread = written(rows.repartitionByRange(F.col(pos)).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(pos))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return spread.withColumn("n", inside).join(counts, "part").withColumn(name, F.format_string(pattern, F.col("n") + F.col("before"))).drop("part", "n", "before")


def final_merge(compact: DataFrame, marginal: DataFrame, generated: DataFrame) -> DataFrame:
    """compact (id, source_id, ...) with its marginal record, which it needs, and its generated text, '' if there is none."""
    texts = generated.select("id", F.col("generated_text").alias("given"))
    met = compact.join(marginal, "source_id").join(texts, "id", "left")
    return met.withColumn("generated_text", F.coalesce("given", F.lit(""))).drop("given")


def merge_skipped(compact: DataFrame, marginal: DataFrame) -> DataFrame:
    return compact.join(marginal.select("source_id"), "source_id", "left_anti")


def positional_merge(compact: DataFrame, marginal: DataFrame, pos: str = "pos") -> DataFrame:
    """By source_id, or by position where a record's source_id is empty."""
    named = compact.where("source_id <> ''").join(marginal.drop(pos), "source_id")
    other = compact.where("source_id is null or source_id = ''").drop("source_id").join(marginal, pos)
    return named.unionByName(other.select(*named.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All keys of both, with the new row where there is one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def not_done(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows a group, without replacement; a group with fewer keeps all."""
    order = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that come first by seeded hash; rows of one key that share the last place fill it up.

    Nothing is sorted: counts by the first digits of the hash tell which digits lie before the n-th row, and
    the digits that it has are looked at more closely, until the rest is whole.
    """
    held = written(rows.withColumn("hash order", hash_order(F.col(key).cast("string"), seed)), "hashes")
    place, left, taken = F.col("hash order"), n, None
    low = ""
    while left > 0:
        digits = F.substring(place, 1, len(low) + 4)
        counts = sorted(map(tuple, held.where(F.startswith(place, F.lit(low))).groupBy(digits).count().collect()))  # 16 ** 4 rows at most
        whole, edge = None, None
        for prefix, m in counts:
            if m > left:
                edge = prefix
                break
            left, whole = left - m, prefix
        if whole is not None:
            # all that begins as `low` does and isn't beyond the last whole digits
            inside = F.startswith(place, F.lit(low)) & (digits <= whole)
            taken = inside if taken is None else taken | inside
        if edge is None or left == 0:
            break
        low = edge
        if len(low) >= 32:
            break
    out = held.where(taken) if taken is not None else held.limit(0)
    if left and len(low) >= 32:
        out = out.unionByName(held.where(place == low).limit(left))
    return out.drop("hash order")


def cap_rows(rows: DataFrame, key: str, required: str, cap: int, seed: int = 42) -> DataFrame:
    """Rows marked `required`, all of them, and as many others, by seeded hash, as the cap leaves room for."""
    must = rows.where(required)
    room = max(0, cap - must.count())
    return must.unionByName(first_by_hash(rows.where(~F.coalesce(F.expr(required), F.lit(False))), key, room, seed))


def sliced(rows: DataFrame, key: str, pos: str, limit: int | None = None, offset: int = 0, start: str | None = None) -> DataFrame:
    """Rows by position from 0: `limit` of them (None or 0: all) after the first `offset`, or from the row with key `start` on.

    start wins over offset; a start that is no key skips nothing.
    """
    found = rows.where(F.col(key) == start).agg(F.min(pos)).first()[0] if start is not None else None
    first = offset if start is None else (found or 0)
    kept = rows.where(F.col(pos) >= first)
    return kept.where(F.col(pos) < first + limit) if limit else kept


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def issue_status(records: DataFrame, issues: DataFrame, key: str = "bn_id") -> DataFrame:
    """records with n_issues, of issues (key, issue), and the status ok or warn."""
    n = issues.groupBy(key).agg(F.count(F.lit(1)).alias("n_issues"))
    met = records.join(n, key, "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0).cast("long")))
    return met.withColumn("status", F.when(F.col("n_issues") > 0, "warn").otherwise("ok"))


def passes_strict(status: Column) -> Column:
    return status == "ok"


def strict(records: DataFrame) -> DataFrame:
    """Of records with a status, those without issues."""
    return records.where(passes_strict(F.col("status")))


def collected_titles(found: DataFrame, target: int, seed: int = 42, kept: int | None = None) -> DataFrame:
    """(domain, title, rank): of search results (domain, domain_pos, seed_pos, result_pos, title), `target` titles a domain.

    Titles with a colon are left out, a title counts in the first domain that has it, collecting stops at
    three times the target, and a seeded order picks among those; kept: so many of them instead of `target`.
    """
    plain = found.where(F.col("title").isNotNull() & ~F.contains("title", F.lit(":")))
    place = F.struct("domain_pos", "seed_pos", "result_pos", "domain")
    first = plain.groupBy("title").agg(F.min(place).alias("at")).select("title", "at.*")
    early = first.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("seed_pos", "result_pos", "title"))).where(F.col("rn") <= 3 * target)
    order = Window.partitionBy("domain").orderBy(hash_order(F.col("title"), seed), "title")
    return early.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (kept or target)).select("domain", "title", "rank")


def per_group_quota(rows: DataFrame, group: str, pos: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(pos)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def articles_in_range(docs: DataFrame, words: Column, least: int = 80, most: int = 800) -> DataFrame:
    return docs.where(words.between(least, most))
