"""All links of a similarity join, once its components are known.

A link never leaves its component. So the members of heavy lists, whose pairs the join doesn't list,
meet the other such members of their component, each pair in one group: a component is dealt to blocks
by a hash, and each pair of blocks is a group. A group gives links, or only how many each set has.
Links with a member outside all heavy lists share light lists only and are known from these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .shingles import shingle_sets

#: Sets and set members of about one block of a component; what a group holds and works is bounded by two blocks.
SETS, MEMBERS = 4000, 1 << 20


def set_bytes(width: int):
    """Rows (c, blocks, node, w, n, s) of (c, blocks, node, w, k1, text): the sorted set as bytes, where it is the one meant."""

    def run(batches):
        for batch in batches:
            keep, size, raw = [], [], []
            for i, s in enumerate(shingle_sets((t.as_py() for t in batch.column(5)), width)):
                if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] == batch.column(4)[i].as_py():
                    keep.append(i)
                    size.append(len(s))
                    raw.append(s.tobytes())
            columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:4]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["c", "blocks", "node", "w", "n", "s"])

    return run


def similar(sets: list[np.ndarray], first: np.ndarray, percent: int, within: bool):
    """(i, others) for each set i of the first block: the sets of the second one, or of its own after it, that it links with.

    Members are numbered; a set marks its own, and the marks are summed along the sets whose sizes allow a link.
    """
    size = np.array([len(s) for s in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine = np.split(number, np.cumsum(size)[:-1])
    order = np.argsort(size, kind="stable")
    second = order if within else order[~first[order]]
    ours = second if within else order[first[order]]
    if not len(second) or not len(ours):
        return
    flat = np.concatenate([mine[i] for i in second])
    n = size[second]
    at = np.concatenate([[0], np.cumsum(n)])
    marks = np.zeros(int(number.max()) + 1, np.int32)
    for place, i in enumerate(ours):
        low = np.searchsorted(100 * n, percent * size[i])
        if within:
            low = max(low, place + 1)
        high = np.searchsorted(percent * n, 100 * size[i], "right")
        if low < high:
            marks[mine[i]] = 1
            both = np.add.reduceat(marks[flat[at[low]:at[high]]], at[low:high] - at[low])
            marks[mine[i]] = 0
            found = 100 * both.astype(np.int64) >= percent * (n[low:high] + size[i] - both)
            if found.any():
                yield i, second[low:high][found]


def group_links(percent: int, counts: bool):
    """Of a group's table: rows (node, k), how many rows of the documents each set links with here, or the links (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        node, w, x, y = (table.column(c).to_numpy() for c in ("node", "w", "x", "y"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("s")]
        first, within = table.column("own").to_numpy() == x, bool(x[0] == y[0])
        total, ends = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64),) * 2]
        for i, others in similar(sets, first, percent, within):
            total[i] += w[others].sum()
            total[others] += w[i]
            if not counts:
                ends.append((np.minimum(node[i], node[others]), np.maximum(node[i], node[others])))
        if counts:
            return pa.table({"node": node[total > 0], "k": total[total > 0]})
        return pa.table({"a": np.concatenate([e[0] for e in ends]), "b": np.concatenate([e[1] for e in ends])})

    return run


def heavy_links(source: DataFrame, reps: DataFrame, labels: DataFrame, members: DataFrame, percent: int, width: int, counts: bool, most: int = SETS) -> DataFrame:
    """The links between members (node) of heavy lists: (node, k) with counts, else (a, b); each link is found in one group.

    Sets are sent as hashes, once to every block of their component; a component without two members sends none.
    """
    near = labels.join(members, "node").join(reps, "node").select("node", F.col("component").alias("c"), "id", "k1", "n", "w")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / MEMBERS)).cast("int").alias("blocks")
    wide = near.groupBy("c").agg(blocks, F.count(F.lit(1)).alias("size")).where("size > 1").select("c", "blocks")
    wanted = near.join(wide, "c").alias("m")
    texts = source.alias("s").join(wanted, F.col("s.id").eqNullSafe(F.col("m.id"))).select("c", "blocks", "node", "w", "k1", "text")
    rows = texts.mapInArrow(tidy(set_bytes(width)), "c bigint, blocks int, node bigint, w bigint, n bigint, s binary").dropDuplicates(["node"])
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "w", "s")
    return dealt.groupBy("c", "x", "y").applyInArrow(group_links(percent, counts), "node bigint, k bigint" if counts else "a bigint, b bigint")


def light_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """The known links (a, b) that have an end outside all heavy lists."""
    ends = lambda x: members.select(F.col("node").alias(x), F.lit(True).alias(f"heavy_{x}"))
    marked = links.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    return marked.where("heavy_a is null or heavy_b is null").select("a", "b")


def link_counts(links: DataFrame, reps: DataFrame, members: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, k): the rows of the documents, other than its own copies, that each set links with."""
    light = light_links(links, members)
    both = light.select(F.col("a").alias("node"), F.col("b").alias("other")).union(light.select("b", "a"))
    weights = reps.select(F.col("node").alias("other"), F.col("w").alias("k"))
    return both.join(weights, "other").select("node", "k").union(heavy).groupBy("node").agg(F.sum("k").alias("k"))
