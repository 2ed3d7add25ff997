"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

#: Chance that a pair right at the threshold shares a bucket in no table.
MISS = 0.0005
#: Vectors that an average bucket of the largest label would hold if directions were spread evenly.
FILL = 8
#: Rows of a bucket that one group compares; larger buckets are cut into blocks, and every pair of blocks is a group.
BLOCK = 2000
#: Standard deviations by which the differing signs of a pair at the threshold may exceed their mean before vectors are
#: sent; beyond them are about one in 10**9 such pairs, far fewer than MISS.
SLACK = 6.0


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): bits grow with the log of the largest label so buckets stay small, tables so that recall holds."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, largest) / FILL))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - agree)), bits


def most_differing(signs: int, threshold: float) -> int:
    """Signs in which a pair at the threshold differs at most, but for SLACK."""
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + SLACK * math.sqrt(signs * p * (1 - p)))


def usable(vector: Column, label: Column) -> Column:
    """A label, and a vector without null or non-finite components that isn't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_type(bits: int) -> np.dtype:
    return np.dtype(np.uint16 if bits <= 16 else np.int32)


def signature_rows(tables: int, bits: int, seed: int):
    """(node, label, dim, copies, vector bytes, signature bytes) of (node, label, vector, copies)."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node, label, copies = batch.column(0), batch.column(1), batch.column(3)
            values, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(2).value_lengths().to_numpy())
            vecs, sigs, dims = [], [], []
            sizes = np.diff(np.concatenate([[0], ends]))
            x = np.empty(batch.num_rows, object)
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + int(dim)).standard_normal((int(dim), tables * bits))
                at = np.flatnonzero(sizes == dim)
                v = unit(values[(ends[at] - dim)[:, None] + np.arange(dim)])
                for a in range(0, len(at), 2000):
                    s = ((v[a:a + 2000] @ planes[dim] > 0).reshape(-1, tables, bits) @ weights).astype(sign_type(bits))
                    for i, j in enumerate(at[a:a + 2000]):
                        x[j] = (v[a + i].tobytes(), s[i].tobytes())
            vecs, sigs, dims = [r[0] for r in x], [r[1] for r in x], sizes.astype(np.int32)
            shown = np.frombuffer(b"".join(sigs), sign_type(bits)).astype(np.int32)
            table = pa.ListArray.from_arrays(pa.array(np.arange(0, len(shown) + 1, tables, dtype=np.int32)), pa.array(shown))
            yield pa.RecordBatch.from_arrays([node, label, pa.array(dims), copies, pa.array(vecs, pa.binary()), pa.array(sigs, pa.binary()), table], names=["node", "label", "dim", "copies", "vec", "sig", "buckets"])

    return run


def group_links(x, sigs, side, copies, table: int, threshold: float):
    """(links, lead) of the rows of a group: copies of the rows that they link with here, and a smaller row of their part.

    A pair counts in the first table whose bucket it shares, so no pair counts twice. side is -1 where
    all rows are compared with each other, else rows of side 0 are compared with those of side 1.
    """
    n = len(x)
    links, lead = np.zeros(n, np.int64), np.arange(n)
    a = np.flatnonzero(side <= 0)
    b = np.flatnonzero(side != 0) if (side >= 0).any() else a
    for at in range(0, len(a), 500):
        some = a[at:at + 500]
        i, j = np.nonzero(x[some] @ x[b].T >= threshold)
        i, j = some[i], b[j]
        if (side < 0).all():
            i, j = i[i < j], j[i < j]
        first = np.empty(len(i), np.int64)
        for p in range(0, len(i), 100_000):
            first[p:p + 100_000] = (sigs[i[p:p + 100_000]] == sigs[j[p:p + 100_000]]).argmax(axis=1)
        i, j = i[first == table], j[first == table]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while len(i):
            low = np.minimum(lead[i], lead[j])
            before = lead.copy()
            np.minimum.at(lead, i, low)
            np.minimum.at(lead, j, low)
            np.minimum.at(lead, before[i], low)
            np.minimum.at(lead, before[j], low)
            if (lead == before).all():
                break
    return links, lead


def close_members(sigs: np.ndarray, side: np.ndarray, table: int, most: int) -> np.ndarray:
    """Which rows of a group have a partner whose signs differ in `most` at most and that they first meet in this table."""
    found = np.zeros(len(sigs), bool)
    a = np.flatnonzero(side <= 0)
    b = np.flatnonzero(side != 0) if (side >= 0).any() else a
    for at in range(0, len(a), 200):
        some = a[at:at + 200]
        apart = sigs[some][:, None, :] ^ sigs[b][None, :, :]
        near = np.bitwise_count(apart).sum(axis=2, dtype=np.int32) <= most
        near &= some[:, None] != b[None, :]
        i, j = np.nonzero(near)
        first = (apart[i, j] == 0).argmax(axis=1) == table
        found[some[i[first]]] = True
        found[b[j[first]]] = True
    return found


def screen_rows(tables: int, bits: int, most: int):
    """The (node, t, bi, bj, side) of the rows (g, node, t, bi, bj, side, sig), sorted by g, whose vectors must be compared there.

    g is a hash of the group; groups that share one only send more. At most a batch and a group are held.
    """

    def run(batches):
        held: list[np.ndarray] | None = None

        def work(cols):
            g, t, side, sigs = cols[0], cols[2], cols[5], cols[6]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            keep = np.zeros(len(g), bool)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(g)], strict=True):
                if b - a > 1:
                    keep[a:b] = close_members(sigs[a:b], side[a:b], int(t[a]), most)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[1:6]], names=["node", "t", "bi", "bj", "side"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            cols.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), sign_type(bits)).reshape(-1, tables))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield work([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield work(held)

    return run


def compare_rows(tables: int, bits: int, threshold: float):
    """(node, other, links) from rows sorted by group; a group that runs over batches is held, at most two blocks."""

    def run(batches):
        held: list = []
        key = None

        def flush():
            if len(held) < 2:
                return None
            node = np.array([r["node"] for r in held], np.int64)
            links, lead = group_links(np.frombuffer(b"".join(r["vec"] for r in held)).reshape(len(held), -1), np.frombuffer(b"".join(r["sig"] for r in held), sign_type(bits)).reshape(len(held), tables),
                                      np.array([r["side"] for r in held]), np.array([r["copies"] for r in held], np.int64), key[2], threshold)
            some = links > 0
            if not some.any():
                return None
            return node[some], node[lead][some], links[some]

        done: list = []
        for batch in batches:
            for row in batch.to_pylist():
                k = (row["label"], row["dim"], row["t"], row["bucket"], row["bi"], row["bj"])
                if k != key:
                    if (out := flush()) is not None:
                        done.append(out)
                    held, key = [], k
                held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], names=["node", "other", "links"])
                done = []
        if (out := flush()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, seed: int = 11) -> DataFrame:
    """One row a row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label and length link at a cosine of `threshold` or more, tested in double precision
    for every pair that shares a bucket in some table and whose signs, all tables together, are close. Equal vectors of a label are compared once and
    count as linked with each other. Null, zero and non-finite vectors and null labels link with nothing:
    n_links 0, component their own id. Repeated rows link with each other. Null ids take part; they
    never become a component_id unless a component has no other, and aren't kept. Empty tables give empty
    results; extra columns are ignored.
    """
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable(F.col("v"), F.col("label")), F.lit(False)))
    good = rows.where("ok")
    nodes = good.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, bits = plan(largest, threshold)
    label = nodes.schema["label"].dataType.simpleString()
    signed = nodes.select("node", "label", "v", "copies").mapInArrow(signature_rows(tables, bits, seed), f"node bigint, label {label}, dim int, copies bigint, vec binary, sig binary, buckets array<int>")
    signed = staged(signed, "vector-signs")
    key = ["label", "dim", "t", "bucket"]
    at = signed.select("label", "dim", F.posexplode("buckets").alias("t", "bucket"))
    large = at.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    full = signed.select("node", "label", "dim", "sig", F.posexplode("buckets").alias("t", "bucket"))
    full = full.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")
    full = full.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("to"), -1).when(F.col("own") < F.col("to"), 0).otherwise(1)
    full = full.withColumn("bi", F.least("own", "to")).withColumn("bj", F.greatest("own", "to"))
    group = [*key, "bi", "bj"]
    # signs alone go to every bucket; a vector goes only where its signs are close to another's
    narrow = full.select(F.xxhash64(*group).alias("g"), "node", "t", "bi", "bj", side.alias("side"), "sig")
    narrow = narrow.repartition("g").sortWithinPartitions("g")
    close = narrow.mapInArrow(screen_rows(tables, bits, most_differing(tables * bits, threshold)), "node bigint, t int, bi int, bj int, side int")
    met = close.join(signed, "node").select("node", "copies", "vec", "sig", "label", "dim", "t", F.get("buckets", "t").alias("bucket"), "bi", "bj", "side")
    found = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare_rows(tables, bits, threshold), "node bigint, other bigint, links bigint")
    found = staged(found, "vector-links")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(counts, "node", "left").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    names = told.groupBy("c").agg(F.min("low").alias("component_id"))
    told = told.join(names, "c").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.drop("ok").join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
