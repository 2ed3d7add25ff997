"""Hard negatives by exact inner products: sort-tile-recursive packed R-trees, searched best box first."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged, tidy

#: Rows of a leaf, and children of an inner node.
LEAF, FAN = 128, 16
#: Rows of a tree: 32 times the square root of all, within these bounds.
LEAST_PACK, MOST_PACK = 2048, 131072
#: Trees whose outer boxes are told to every task, about 1 KB each at 64 components; beyond it every tree is asked.
DIRECTORY = 65536
#: Anchors that one task compares with one tree, about.
SHARE = 50_000
NO_ID = (1 << 63) - 1
EXACT = float(1 << 53)


def taking_part(vector: Column, label: Column, scale: float) -> Column:
    """A label and a vector, all of whose scaled components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(scale)) == float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) * scale)


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers in the least width that holds them, and the name of that type."""
    top = np.abs(x).max(initial=0)
    kind = next((k for k, most in (("int8", 127), ("int16", 32767), ("int32", 2**31 - 1)) if top <= most), "float64")
    return x.astype(kind).tobytes(), kind


def tile_order(x: np.ndarray) -> np.ndarray:
    """The order of rows in which every LEAF of them make a leaf: sorted by the widest component, cut into slabs, each
    sorted by the next one and cut again, each of those sorted by the third."""
    axes = np.argsort(-x.var(axis=0), kind="stable")[:3] if len(x) else np.arange(0)
    if not len(axes):
        return np.arange(len(x))

    def tiled(rows: np.ndarray, depth: int) -> np.ndarray:
        rows = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        leaves = math.ceil(len(rows) / LEAF)
        if depth + 1 == len(axes) or leaves <= 1:
            return rows
        slabs = math.ceil(leaves ** (1 / (len(axes) - depth)))
        size = LEAF * math.ceil(leaves / slabs)
        return np.concatenate([tiled(rows[a:a + size], depth + 1) for a in range(0, len(rows), size)])

    return tiled(np.arange(len(x)), 0)


class Tree:
    """A packed R-tree over rows in tile order; levels[0] are the boxes under the root, the last level's are leaves."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.top = float(np.abs(x).max(initial=0))
        lo, hi = (f.reduceat(x, np.arange(0, len(x), LEAF)) for f in (np.minimum, np.maximum))
        self.levels = [(lo, hi)]
        while len(lo) > FAN:
            lo, hi = (f.reduceat(b, np.arange(0, len(b), FAN)) for f, b in ((np.minimum, lo), (np.maximum, hi)))
            self.levels.insert(0, (lo, hi))
        # a box's largest inner product takes the high end where the anchor is positive and the low end elsewhere
        self.upper = [np.hstack([h, low]) for low, h in self.levels]
        self.lower = [np.hstack([low, h]) for low, h in self.levels]


def scores_of(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers, held at the ends of a long."""
    if exact:
        return (x @ q).astype(np.int64)
    own = [int(c) for c in q]
    return np.array([max(-NO_ID - 1, min(NO_ID, sum(int(a) * b for a, b in zip(row, own, strict=True)))) for row in x], np.int64)


def best_first(tree: Tree, ids, rows, labels, q, row, label, same: bool, low, high, kth, k: int):
    """(window, score, id) of the k best rows of each window [low, high], all that tie or beat the kth score known so far.

    Boxes wait in a queue by their largest possible score. A box is left out where for every window its scores are
    all outside it or strictly below the window's kth score; the search ends when that holds for the first in the queue.
    """
    exact = float(np.abs(q).sum()) * tree.top < EXACT
    w = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)])
    need = np.maximum(low, kth)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
    queue: list[tuple[float, int, int]] = []

    def push(level: int, a: int, b: int):
        if exact:
            up, down = tree.upper[level][a:b] @ w, tree.lower[level][a:b] @ w
            some = ((up[:, None] >= need) & (down[:, None] <= high)).any(axis=1)
            for i in np.flatnonzero(some).tolist():
                heapq.heappush(queue, (-up[i], level, a + i))
        else:
            for i in range(a, b):
                heapq.heappush(queue, (-math.inf, level, i))

    push(0, 0, len(tree.levels[0][0]))
    while queue:
        up, level, node = heapq.heappop(queue)
        if (-up < need).all():
            break
        if level + 1 < len(tree.levels):
            push(level + 1, node * FAN, min((node + 1) * FAN, len(tree.levels[level + 1][0])))
            continue
        a, b = node * LEAF, min((node + 1) * LEAF, len(tree.x))
        s = scores_of(tree.x[a:b], q, exact)
        fits = ((labels[a:b] == label) == same) & (rows[a:b] != row)
        fits = fits[:, None] & (s[:, None] >= need) & (s[:, None] <= high)
        for i in np.flatnonzero(fits.any(axis=0)).tolist():
            at = fits[:, i]
            score, who = np.concatenate([best[i][0], s[at]]), np.concatenate([best[i][1], ids[a:b][at]])
            order = np.lexsort((who, -score))[:k]
            best[i] = score[order], who[order]
            if len(order) == k:
                need[i] = max(need[i], best[i][0][-1])
    for i, (score, who) in enumerate(best):
        yield from zip([i] * len(score), score.tolist(), who.tolist(), strict=True)


def spread_rows(batches):
    """(place, n, s, ss) of (v): sums of each component and of its square."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.asarray(batch.column(0).value_lengths())
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for dim in np.unique(sizes).tolist():
            x = values[(ends[sizes == dim] - dim)[:, None] + np.arange(dim)]
            sums[dim] = sums.get(dim, np.zeros((3, dim))) + np.array([np.full(dim, len(x)), x.sum(0), (x * x).sum(0)])
    for dim, t in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), *map(pa.array, t)], names=["dim", "place", "n", "s", "ss"])


def pack_rows(scale: float, most: int, label_type: pa.DataType):
    """Trees of (dim, slab, tile, row, id, label, v), sorted by the first three; a tile of over `most` rows makes several."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key, parts = None, 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            x = matrix(t["v"].combine_chunks(), key[0], scale)
            order = tile_order(x)
            x = x[order]
            data, kind = narrow(x)
            lists = [pa.array([t[c].combine_chunks().take(pa.array(order))], pa.list_(kind_)) for c, kind_ in (("row", pa.int64()), ("id", pa.int64()), ("label", label_type))]
            ends = [pa.array([f.reduce(x, axis=0).astype(float).tobytes()], pa.binary()) for f in (np.minimum, np.maximum)]
            name = "/".join(map(str, (*key, parts)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key[0]], pa.int32()), *ends, pa.array([kind]), pa.array([data], pa.binary()), *lists],
                                              names=["pack", "dim", "lo", "hi", "kind", "x", "rows", "ids", "labels"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            a = 0
            while a < len(keys):
                if keys[a] != key:
                    if held:
                        yield close()
                    held, key, parts = [], keys[a], 0
                b = a
                room = most - sum(h.num_rows for h in held)
                while b < len(keys) and keys[b] == key and b - a < room:
                    b += 1
                held.append(batch.slice(a, b - a))
                if b - a == room:
                    yield close()
                    held, parts = [], parts + 1
                a = b
        if held:
            yield close()

    return run


def route_rows(directory, scale: float, first: bool):
    """The trees that anchors (row, label, v, low, high, kth, seen) are to be sought in.

    first: the one with the largest possible score; else all others that may hold a row of some window.
    """

    def run(batches):
        names, dims, lows, highs = directory.value
        boxes = {d: (np.array(names, object)[dims == d], np.array([lows[i] for i in np.flatnonzero(dims == d)]), np.array([highs[i] for i in np.flatnonzero(dims == d)])) for d in np.unique(dims).tolist()}
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(sizes).tolist():
                if dim not in boxes:
                    continue
                some = batch.filter(pa.array(sizes == dim))
                pack, lo, hi = boxes[dim]
                q = matrix(some.column(2), dim, scale)
                exact = np.abs(q).sum(axis=1) * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) < EXACT
                plus, minus = np.maximum(q, 0), np.minimum(q, 0)
                with np.errstate(over="ignore", invalid="ignore"):
                    up = np.where(exact[:, None], plus @ hi.T + minus @ lo.T, np.inf)
                    down = np.where(exact[:, None], plus @ lo.T + minus @ hi.T, -np.inf)
                at, to = [], []
                for i in range(some.num_rows):
                    low, high, kth = (np.array(some.column(c)[i].as_py(), np.int64) for c in (3, 4, 5))
                    fits = ((up[i][:, None] >= np.maximum(low, kth)) & (down[i][:, None] <= high)).any(axis=1)
                    if first:
                        found = [int(np.where(fits, up[i], -np.inf).argmax())] if fits.any() else []
                    else:
                        found = np.flatnonzero(fits & (pack != some.column(6)[i].as_py())).tolist()
                    at += [i] * len(found)
                    to += found
                for a in range(0, len(at), 2000):
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(at[a:a + 2000], pa.int64())).columns[:6], pa.array(pack[to[a:a + 2000]], pa.string())], names=["row", "label", "v", "low", "high", "kth", "pack"])

    return run


def search_rows(scale: float, k: int, same: bool):
    """(row, pack, window, score, id) of trees and, after each, the anchors that it is to be searched for."""

    def run(batches):
        tree = None
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if col["x"][i].is_valid:
                    dim = col["dim"][i].as_py()
                    lists = [col[c][i].values.to_numpy(zero_copy_only=False) for c in ("ids", "rows", "labels")]
                    x = np.frombuffer(col["x"][i].as_py(), col["kind"][i].as_py()).reshape(len(lists[0]), dim).astype(float)
                    tree = Tree(x), *lists
                    continue
                q = np.floor(np.array(col["v"][i].as_py(), float) * scale)
                low, high, kth = (np.array(col[c][i].as_py(), np.int64) for c in ("low", "high", "kth"))
                row = col["row"][i].as_py()
                found = best_first(*tree, q, row, col["label"][i].as_py(), same, low, high, kth, k)
                out += [(row, col["pack"][i].as_py(), *f) for f in found]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "pack", "window", "score", "id"])

    return run


class Index:
    """All rows in packed trees. rows: (row, id, label, v), v of whole numbers after scaling and flooring."""

    def __init__(self, rows: DataFrame, scale: float, seed: int, pack: int | None, directory: int):
        self.scale, self.label = scale, rows.schema["label"].dataType.simpleString()
        spark = rows.sparkSession
        spread = rows.select("v").mapInArrow(tidy(spread_rows), "dim int, place int, n double, s double, ss double").groupBy("dim", "place").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
        variance = F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
        axes = spread.groupBy("dim").agg(F.max("n").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct(variance.alias("var"), "place")), asc=False), 1, 2).alias("axes"))
        total = int(axes.agg(F.sum("n")).first()[0] or 0)
        size = pack or int(min(MOST_PACK, max(LEAST_PACK, 32 * math.sqrt(total))))
        # slabs and tiles by quantiles; equal components are told apart by a hash, so no tile is hot
        cuts = max(1, math.ceil(math.sqrt(total / size)))
        shares = [i / cuts for i in range(1, cuts)]
        axis = lambda i: F.get("axes", F.lit(i))["place"]
        jitter = lambda i: F.shiftrightunsigned(F.xxhash64("row", F.lit(seed + i)), 11) / F.lit(float(1 << 53))
        value = lambda i: F.floor(F.least(F.greatest(F.coalesce(F.get("v", axis(i)), F.lit(0.0)) * scale, F.lit(-1e15)), F.lit(1e15))) + jitter(i)
        placed = rows.withColumn("dim", F.size("v")).join(axes.where("dim > 0").select("dim", "axes"), "dim", "left").withColumn("c0", value(0)).withColumn("c1", value(1)).drop("axes")

        def cut(df: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
            if not shares:
                return df.withColumn(name, F.lit(0))
            ends = df.groupBy(*by).agg(F.percentile_approx(c, shares).alias("ends"))
            return df.join(ends, by).withColumn(name, F.size(F.filter("ends", lambda e: e < F.col(c)))).drop("ends")

        placed = staged(cut(placed, ["dim"], "c0", "slab"), "rtree-slabs")
        tiled = cut(placed, ["dim", "slab"], "c1", "tile").select("dim", "slab", "tile", "row", "id", "label", "v")
        key = ["dim", "slab", "tile"]
        tiled = tiled.repartition(max(1, cuts * cuts), *key).sortWithinPartitions(*key)
        arrow = {"string": pa.string()}.get(self.label, pa.int64())
        packs = tiled.mapInArrow(tidy(pack_rows(scale, 2 * size, arrow)), f"pack string, dim int, lo binary, hi binary, kind string, x binary, rows array<bigint>, ids array<bigint>, labels array<{self.label}>")
        self.packs = staged(packs, "rtree-packs")
        dropped(placed)
        self.n = self.packs.count()
        self.directory = None
        if self.n <= directory:
            found = self.packs.select("pack", "dim", "lo", "hi").collect()  # `directory` rows at most
            self.directory = spark.sparkContext.broadcast(([r["pack"] for r in found], np.array([r["dim"] for r in found], np.int64), [np.frombuffer(r["lo"]) for r in found], [np.frombuffer(r["hi"]) for r in found]))

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, window, score, id, rank) of anchors (row, label, v, low, high): of each window the k best rows, larger scores and smaller ids first.

        same: rows of the anchor's label but itself; else rows of other labels. The tree with the largest
        bound is searched first; its kth scores keep anchors away from trees that are strictly below them.
        """
        lowest = F.lit(-NO_ID - 1).cast("bigint")
        anchors = anchors.withColumn("kth", F.transform("low", lambda _: lowest)).withColumn("seen", F.lit(""))
        shape = f"row bigint, label {self.label}, v array<double>, low array<bigint>, high array<bigint>, kth array<bigint>, pack string"
        if self.directory is None:
            asked = anchors.drop("seen").withColumn("dim", F.size("v")).join(self.packs.select("pack", "dim"), "dim").drop("dim")
            found = staged(self._ask(staged(asked, "rtree-asked"), k, same), "rtree-found")
            return self._ranked(found, k)
        one = staged(anchors.mapInArrow(tidy(route_rows(self.directory, self.scale, True)), shape), "rtree-asked")
        first = staged(self._ask(one, k, same), "rtree-first")
        best = self._ranked(first, k).where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("best"))
        where = one.select("row", F.col("pack").alias("seen"))
        known = anchors.drop("kth", "seen").join(where, "row").join(best, "row", "left")
        kth = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("best", i), lowest))
        more = known.select("row", "label", "v", "low", "high", kth.alias("kth"), "seen").mapInArrow(tidy(route_rows(self.directory, self.scale, False)), shape)
        rest = staged(self._ask(staged(more, "rtree-asked"), k, same), "rtree-rest")
        return self._ranked(first.union(rest), k)

    def _ask(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """The rows found of (…, pack), a staged table: trees and the anchors sent to them, sorted so that a tree comes first."""
        salts = max(1, math.ceil(asked.count() / max(1, self.n) / SHARE))
        packs = self.packs.select("pack", "dim", "kind", "x", "rows", "ids", "labels").join(asked.select("pack").distinct(), "pack", "left_semi")
        packs = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = packs.unionByName(asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")), allowMissingColumns=True)
        both = both.repartition(max(1, self.n * salts), "pack", "salt").sortWithinPartitions("pack", "salt", F.col("x").isNull())
        return both.mapInArrow(tidy(search_rows(self.scale, k, same)), "row bigint, pack string, window int, score bigint, id bigint").drop("pack")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90, seed: int = 17, pack: int | None = None, directory: int = DIRECTORY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component becomes floor(scale * x); scores are inner products of whole numbers, held at the ends of
    a long. Rows where is_anchor holds are anchors. An anchor's positives are its `positives` best other rows
    of its label; for each, the `negatives` best rows of other labels whose score is from `least` to `most`
    percent of the positive's. Larger scores come first, ties by smaller id, null ids last.

    Rows with a null label, a null vector or a component that is null or, scaled, not finite take no part;
    vectors meet others of their length only, and empty ones score 0. Every row counts, repeated ones too:
    another row with an anchor's own id is another row, and an anchor row that is repeated gives its results
    again. Anchors without positives, and positives without negatives, give no rows; empty tables give none.
    Labels are strings or whole numbers, ids are below 2**63 - 1; extra columns are ignored.
    """
    label = vectors[label_col]
    if vectors.schema[label_col].dataType.simpleString() != "string":
        label = label.cast("bigint")
    found = vectors.select(vectors[id_col].cast("bigint").alias("id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    found = found.where(taking_part(F.col("v"), F.col("label"), scale)).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    rows = staged(found.withColumn("row", F.monotonically_increasing_id()), "rtree-rows")
    index = Index(rows.drop("is_anchor"), scale, seed, pack, directory)
    anchors = rows.where("is_anchor").select("row", "id", "label", "v")
    whole = anchors.select("row", "label", "v", F.array(F.lit(-NO_ID - 1).cast("bigint")).alias("low"), F.array(F.lit(NO_ID)).alias("high"))
    near = staged(index.search(whole, positives, True).select("row", "rank", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "rtree-positives")
    # least * s <= 100 * n <= most * s, in whole numbers; decimals hold the products
    wide = F.col("positive_score").cast("decimal(20,0)")
    low = F.ceil(wide * least / 100).cast("bigint")
    high = F.floor(wide * most / 100).cast("bigint")
    asked = near.where("positive_score >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high"), "positive_id", "positive_score"))).alias("w"))  # `positives` entries at most
    asked = staged(asked, "rtree-windows")
    windows = anchors.join(asked, "row").select("row", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    worst = index.search(windows, negatives, False)
    out = worst.join(asked, "row").join(anchors.select("row", F.col("id").alias("anchor_id")), "row").withColumn("p", F.get("w", F.col("window")))
    named = lambda c: F.when(c != NO_ID, c)
    result = out.select(named(F.col("anchor_id")).alias("anchor_id"), named(F.col("p.positive_id")).alias("positive_id"), "rank", named(F.col("id")).alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
    return result
