"""N-gram Jaccard join: a size-aware heavy-light join.

Small sets enumerate the subsets that a partner must share; large sets are found by scanning inverted
lists. A partner of a set of n members shares needed(n) of them at least, and its own size decides how
many of these it has beside others; so a small set lists its subsets of every size from needed(n) to n,
and two sets meet in the subset that both have whole. Light lists give their pairs; heavy lists give
stars, first around the member that is in most heavy lists, and only what the stars leave in different
components is compared further, in blocks; the links that this leaves out are found inside the components
(links.py). Sizes and parity signatures, whose length follows the size of
the set, tell unlike pairs apart without their texts; every other candidate is verified on whole texts.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, staged, tidy
from .components import connected_components
from .links import heavy_links, light_links, link_counts
from .shingles import shingle_sets

#: Buckets of the frequency sketch: its size is fixed, and so is what is broadcast.
SKETCH = 1 << 16
#: Lists of at most so many sets are light: all their pairs become candidates.
LIGHT = 4
#: Centres of a heavy list, before its members that are still apart are compared one by one.
STARS = 3
#: Bits of every set's short parity signature, an exact lower bound for symmetric differences, and its columns.
PARITY = 512
BITS = [f"p{i}" for i in range(PARITY // 64)]
#: Members of a list that meet in one group; longer lists are cut into blocks, whose pairs are groups.
BLOCK = 2000


def needed(n: int, percent: int) -> int:
    """Members of a set of size n that any partner must share."""
    return -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, i) for i in range(n - needed(n, percent) + 1))


def boundary(list_length: float, percent: int) -> int:
    """The largest size up to which listing a set's subsets costs no more than scanning the lists of its prefix."""
    n = 0
    while n < 64 and subset_count(n + 1, percent) <= (n + 2 - needed(n + 1, percent)) * max(1.0, list_length):
        n += 1
    return n


def signatures(members: np.ndarray, load: np.ndarray, small: int, percent: int) -> np.ndarray:
    """What a set is listed under.

    A set of at most `small` members: a hash for every subset of at least needed() of them. A larger one:
    the rarest n - needed() + 1 members, in the order of the sketch; partners share one of these whatever
    the order is. A small set that may have a larger partner is listed both ways.
    """
    n, out = len(members), []
    if n <= small:
        mixed = mix64(members ^ np.uint64(0x5851F42D4C957F2D))
        total = mixed.sum(dtype=np.uint64)
        out = [total]
        for gone in range(1, n - needed(n, percent) + 1):
            out += [(int(total) - int(mixed[list(c)].sum(dtype=np.uint64))) % (1 << 64) for c in combinations(range(n), gone)]
        out = list(mix64(np.array(out, np.uint64)))
    if n > small or 100 * n >= percent * (small + 1):
        order = np.argsort(load[members & np.uint64(SKETCH - 1)], kind="stable")
        out = np.concatenate([np.array(out, np.uint64), members[order[: n - needed(n, percent) + 1]]])
    return np.asarray(out, np.uint64)


def sketched(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)


def parity(members: np.ndarray, bits: int) -> np.ndarray:
    """Which of `bits` buckets, by the first bits of a hash, hold an odd number of members; packed into bytes."""
    bucket = (members >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8))


def fine_parity(members: np.ndarray) -> bytes | None:
    """A parity signature of a bit or two a member, so that it tells sets of any size apart; None where the short one does."""
    return parity(members, 1 << len(members).bit_length()).tobytes() if len(members) > PARITY else None


def fold(packed: np.ndarray, size: int) -> np.ndarray:
    """Rows of signatures, brought to `size` bytes by joining neighbouring buckets."""
    while packed.shape[1] > size:
        bits = np.unpackbits(packed, axis=1)
        packed = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)
    return packed


def set_rows(width: int):
    """Rows (id, kind, n, k1, k2, parity, fine) for each text, and the sketch's (bucket n, count k1) of each task as kind 1."""
    names = ["id", "kind", "n", "k1", "k2", *BITS, "fine"]

    def run(batches):
        load = np.zeros(SKETCH, np.int64)
        kind = None
        for batch in batches:
            ids, kind = batch.column(0), batch.column(0).type
            rows, fine, members = [], [], [np.zeros(0, np.uint64)]
            for s in shingle_sets((t.as_py() for t in batch.column(1)), width):
                members.append(s)
                if len(members) > 1000:
                    load += sketched(members)
                    members = members[:1]
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                rows.append((len(s), *key, *parity(s, PARITY).view(np.int64)))
                fine.append(fine_parity(s))
            load += sketched(members)
            cols = np.array(rows, np.int64).reshape(len(rows), 3 + len(BITS)).T
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(len(rows), np.int8)), *(pa.array(c) for c in cols), pa.array(fine, pa.binary())], names=names)
        if kind is not None:
            full = np.flatnonzero(load)
            none, columns = pa.array(np.zeros(len(full), np.int64)), [pa.array(np.ones(len(full), np.int8)), pa.array(full), pa.array(load[full])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), kind), *columns, *[none] * (1 + len(BITS)), pa.nulls(len(full), pa.binary())], names=names)

    return run


def list_rows(load, small: int, percent: int, width: int):
    """Rows (id, k1, k2, sigs) for each text with a set."""

    def run(batches):
        order = load.value
        for batch in batches:
            keep, keys, sigs = [], [], []
            for i, s in enumerate(shingle_sets((t.as_py() for t in batch.column(1)), width)):
                if len(s):
                    keep.append(i)
                    keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                    sigs.append(signatures(s, order, small, percent).view(np.int64))
            k = np.array(keys, np.int64).reshape(len(keys), 2)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "k1", "k2", "sigs"])

    return run


def scan_lists(most: int):
    """Of (sig, node) rows sorted by both: kind 0 rows are the pairs of light lists, kind 1 rows the members of heavy ones.

    Memory is bounded by a batch and `most` rows.
    """

    def run(batches):
        def rows(a, b, kind):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        held_s = held_v = np.zeros(0, np.int64)
        heavy = last = None  # the heavy list that the last batch ended in; its last row, to drop a repeated one

        def whole(s, v, starts):
            """Of whole lists, or the first part of a heavy one."""
            sizes = np.diff(np.append(starts, len(s)))
            light = np.repeat(sizes <= most, sizes)
            of = np.repeat(np.arange(len(starts)), sizes)
            for d in range(1, min(most, len(s))):
                ok = light[:-d] & (of[:-d] == of[d:])
                if ok.any():
                    yield rows(v[:-d][ok], v[d:][ok], 0)
            if not light.all():
                yield rows(s[~light], v[~light], 1)

        for batch in batches:
            s, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
            new[0] = last != (s[0], v[0])
            last = (s[-1], v[-1])
            s, v = s[new], v[new]
            if heavy is not None:
                n = int(np.searchsorted(s, heavy, "right"))
                if n:
                    yield rows(s[:n], v[:n], 1)
                if n == len(s):
                    continue
                heavy, s, v = None, s[n:], v[n:]
            s, v = np.concatenate([held_s, s]), np.concatenate([held_v, v])
            if not len(s):
                continue
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            cut = starts[-1]
            if cut:
                yield from whole(s[:cut], v[:cut], starts[:-1])
            held_s, held_v = s[cut:], v[cut:]
            if len(held_s) > most:
                heavy = held_s[0]
                yield from whole(held_s, held_v, np.zeros(1, np.int64))
                held_s = held_v = np.zeros(0, np.int64)
        if len(held_s) > 1:
            yield from whole(held_s, held_v, np.zeros(1, np.int64))

    return run


def close_rows(percent: int):
    """The (a, b) rows of (a, b, na, nb, fa, fb) whose fine signatures allow the similarity; an exact test for what cannot link."""

    def run(batches):
        for batch in batches:
            size = batch.column(4), batch.column(5)
            la, lb = (np.array([len(x) for x in (v.as_buffer() for v in c)], np.int64) for c in size)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
                of = np.flatnonzero((la == x) & (lb == y))
                for at in range(0, len(of), 500):
                    some = of[at:at + 500]
                    one, two = (fold(np.frombuffer(b"".join(c[i].as_py() for i in some.tolist()), np.uint8).reshape(len(some), -1), min(x, y)) for c in size)
                    flips = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
                    keep[some] = flips * (100 + percent) <= total[some] * (100 - percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


class Fine:
    """Fine signatures of a group's sets, rows of one length together; folded ones are kept."""

    def __init__(self, fine: list):
        self.size = np.array([0 if f is None else len(f) for f in fine], np.int64)
        self.place, self.rows = np.zeros(len(fine), np.int64), {}
        for x in np.unique(self.size[self.size > 0]).tolist():
            of = np.flatnonzero(self.size == x)
            self.place[of] = np.arange(len(of))
            self.rows[x, x] = np.frombuffer(b"".join(fine[i] for i in of.tolist()), np.uint8).reshape(len(of), x)

    def at(self, of: np.ndarray, x: int, size: int) -> np.ndarray:
        """The signatures, of x bytes, of the sets `of`, at `size` bytes."""
        if (x, size) not in self.rows:
            self.rows[x, size] = fold(self.rows[x, x], size)
        return self.rows[x, size][self.place[of]]

    def flips(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many bits set i differs from each of the others, which have fine signatures as it has."""
        out, mine = np.zeros(len(others), np.int64), int(self.size[i])
        for x in np.unique(self.size[others]).tolist():
            of, least = np.flatnonzero(self.size[others] == x), min(x, mine)
            one = self.at(np.array([i]), mine, least)
            for k in range(0, len(of), 500):
                some = of[k:k + 500]
                out[some] = np.bitwise_count(one ^ self.at(others[some], x, least)).sum(axis=1, dtype=np.int64)
        return out


def apart_rows(percent: int):
    """Of a group's table: the pairs (a, b) of different components, one of them not the lead's, that sizes and signatures leave.

    A set is compared with all that its size allows, in arrays; only pairs that every bound leaves become rows.
    """

    def run(table: pa.Table) -> pa.Table:
        node, c, lead, n, own, x, y = (table.column(k).to_numpy() for k in ("node", "c", "lead", "n", "own", "x", "y"))
        order = np.argsort(n, kind="stable")
        node, c, n, own, lead, within = node[order], c[order], n[order], own[order], lead[0], bool(x[0] == y[0])
        short = np.stack([table.column(p).to_numpy()[order] for p in BITS], axis=1).view(np.uint64)
        fine = Fine([table.column("fine")[i].as_py() for i in order.tolist()])
        ends = [(np.zeros(0, np.int64),) * 2]
        for i in np.flatnonzero(c != lead).tolist():
            low, high = np.searchsorted(100 * n, percent * n[i]), np.searchsorted(percent * n, 100 * n[i], "right")
            met = np.arange(low, high)
            met = met[(c[low:high] != c[i]) & ((c[low:high] == lead) | (met > i)) & (within | (own[low:high] != own[i]))]
            allowed = (n[met] + n[i]) * (100 - percent)
            left = np.bitwise_count(short[met] ^ short[i]).sum(axis=1, dtype=np.int64) * (100 + percent) <= allowed
            met, allowed = met[left], allowed[left]
            large = np.minimum(n[met], n[i]) > PARITY
            if large.any():
                left = ~large
                left[large] = fine.flips(i, met[large]) * (100 + percent) <= allowed[large]
                met = met[left]
            ends.append((np.minimum(node[i], node[met]), np.maximum(node[i], node[met])))
        return pa.table({"a": np.concatenate([e[0] for e in ends]), "b": np.concatenate([e[1] for e in ends])})

    return run


def verify_rows(percent: int, width: int):
    """The (a, b) rows of (a, b, ka, kb, text_a, text_b) whose sets are the ones meant and similar enough."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                a, b, ka, kb = (c.to_pylist() for c in batch.slice(at, 500).columns[:4])
                texts: dict = {}
                for ids, keys, column in ((a, ka, 4), (b, kb, 5)):
                    for x, text in zip(zip(ids, keys, strict=True), batch.column(column).slice(at, 500), strict=True):
                        if x not in texts:
                            texts[x] = text.as_py()
                sets = dict(zip(texts, shingle_sets(texts.values(), width), strict=True))
                same = {x for x, s in sets.items() if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] == x[1]}
                out = []
                for x, y in zip(zip(a, ka, strict=True), zip(b, kb, strict=True), strict=True):
                    if x in same and y in same:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            out.append((x[0], y[0]))
                found = np.array(out, np.int64).reshape(len(out), 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _near(percent: int):
    """Sizes and short parity signatures allow the similarity: an exact test for what cannot link."""
    flips = sum(F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in BITS)
    total = F.col("a.n") + F.col("b.n")
    return (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & (flips * (100 + percent) <= total * (100 - percent))


def candidates(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of distinct pairs that the exact bounds leave: first the short signatures, then, of large sets, the fine ones."""
    facts = reps.select("node", "n", *BITS)
    met = pairs.alias("p").join(facts.alias("a"), F.col("p.a") == F.col("a.node")).join(facts.alias("b"), F.col("p.b") == F.col("b.node"))
    met = staged(met.where(_near(percent)).select("p.a", "p.b", F.col("a.n").alias("na"), F.col("b.n").alias("nb")), "jaccard-near")
    large = F.least("na", "nb") > PARITY
    fine = reps.where(F.col("n") > PARITY).select("node", "fine")
    of = lambda x: fine.select(F.col("node").alias(x), F.col("fine").alias(f"f{x}"))
    both = met.where(large).join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "fa", "fb")
    found = staged(met.where(~large).select("a", "b").union(both.mapInArrow(close_rows(percent), "a bigint, b bigint")), "jaccard-pairs")
    dropped(met)
    return found


def verified(pairs: DataFrame, reps: DataFrame, source: DataFrame, percent: int, width: int) -> DataFrame:
    """The links among pairs. Only texts of sets that are in a pair are sent; a hot set's rows can be split."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = reps.join(nodes, "node").select("node", "id", "k1").alias("w")
    texts = source.alias("s").join(wanted, F.col("s.id").eqNullSafe(F.col("w.id"))).select("node", "k1", "text")
    of = lambda x: texts.select(F.col("node").alias(x), F.col("k1").alias(f"k{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ka", "kb", "text_a", "text_b")
    return staged(both.mapInArrow(tidy(verify_rows(percent, width)), "a bigint, b bigint").distinct(), "jaccard-links")


def stars(heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a heavy list (sig, node, degree) with the list's centres.

    Centres are the member in most heavy lists, likely what the others are copies of, and members by
    chance, by a hash of the node alone, so that lists of the same sets choose alike.
    """
    by = [F.max(F.struct("degree", "node"))["node"], *(F.max(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(1, STARS))]
    centres = heavy.groupBy("sig").agg(F.array_distinct(F.array(*by)).alias("centres"))
    pairs = heavy.join(centres, "sig").select("node", F.explode("centres").alias("centre")).where("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def open_lists(heavy: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, c, lead, size) of the heavy lists whose members aren't all in one component; lead: the first centre's.

    Of lists that have the same members, one stands for all: their pairs are the same.
    """
    named = heavy.join(labels, "node", "left").select("sig", "node", "degree", F.coalesce("component", "node").alias("c"))
    lead = F.max(F.struct("degree", "node", "c"))["c"].alias("lead")
    who = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"who{i}") for i in range(2)]
    lists = named.groupBy("sig").agg(lead, F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), *who)
    lists = lists.where("lo < hi").groupBy("size", "who0", "who1").agg(F.min(F.struct("sig", "lead")).alias("s"))
    return named.join(lists.select("s.sig", "s.lead", "size"), "sig").select("sig", "node", "c", "lead", "size")


def apart(rest: DataFrame, reps: DataFrame, percent: int, block: int) -> DataFrame:
    """Distinct pairs (a, b) of open lists' members that are in different components and that the exact bounds leave.

    A list's members are dealt to blocks; each pair of blocks is a group, so a long list is dealt to many
    tasks. What cannot link is told apart inside the group and never becomes a row.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rest.join(reps.select("node", "n", *BITS, "fine"), "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "c", "lead", "n", *BITS, "fine")
    return dealt.groupBy("sig", "x", "y").applyInArrow(apart_rows(percent), "a bigint, b bigint").distinct()


class Joined(NamedTuple):
    """What a join has found: texts, their sets, a row a distinct set, components, links that span them, members of heavy lists."""

    source: DataFrame
    sets: DataFrame
    reps: DataFrame
    labels: DataFrame
    links: DataFrame
    members: DataFrame | None


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, light: int, block: int, whole: bool) -> Joined:
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    bits = ", ".join(f"{p} bigint" for p in BITS)
    counted = staged(source.mapInArrow(tidy(set_rows(width)), f"id {kind}, kind tinyint, n bigint, k1 bigint, k2 bigint, {bits}, fine binary"), "jaccard-sets")
    sets = counted.where("kind = 0").drop("kind")
    load = np.zeros(SKETCH, np.int64)
    for r in counted.where("kind = 1").groupBy("n").agg(F.sum("k1").alias("k")).toLocalIterator():  # SKETCH rows at most
        load[r["n"]] = r["k"]
    members = max(1, int(load.sum()))
    small = boundary(float((load.astype(float) ** 2).sum() / members - members / SKETCH), percent)
    reps = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", *BITS, "fine")), F.count(F.lit(1)).alias("w"))
    reps = staged(reps.withColumn("node", F.monotonically_increasing_id()), "jaccard-reps")

    shared = spark.sparkContext.broadcast(load)
    listed = source.mapInArrow(tidy(list_rows(shared, small, percent, width)), f"id {kind}, k1 bigint, k2 bigint, sigs array<bigint>").alias("l")
    r = reps.select("id", "k1", "k2", "node").alias("r")
    listed = listed.join(r, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.k1") == F.col("r.k1")) & (F.col("l.k2") == F.col("r.k2")))
    postings = listed.select(F.explode("sigs").alias("sig"), "node").repartition("sig").sortWithinPartitions("sig", "node")
    scanned = staged(postings.mapInArrow(tidy(scan_lists(light)), "kind tinyint, a bigint, b bigint"), "jaccard-lists")

    heavy = scanned.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"))
    heavy = staged(heavy.join(heavy.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node"), "jaccard-heavy")
    near = scanned.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = candidates(near.union(stars(heavy)).distinct(), reps, percent)
    dropped(scanned)
    links = verified(pairs, reps, source, percent, width)
    labels = connected_components(links)

    members = staged(heavy.select("node").distinct(), "jaccard-members") if whole else None
    rest = staged(open_lists(heavy, labels), "jaccard-apart")
    dropped(heavy)
    met = staged(apart(rest, reps, percent, block), "jaccard-met")
    more = staged(met.join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
    dropped(rest, pairs, met)
    if not more.isEmpty():
        old = links
        links = staged(old.union(verified(more, reps, source, percent, width)), "jaccard-links")
        dropped(old, labels)
        labels = connected_components(links)
    dropped(more)

    return Joined(source, sets, reps, labels, links, members)


def _documents(found: Joined, counts: DataFrame | None = None) -> DataFrame:
    joined = found.reps.join(found.labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    names = joined.groupBy("c").agg(F.min("id").alias("component_id"))
    more = []
    if counts is not None:
        joined = joined.join(counts, "node", "left").withColumn("n_links", F.col("w") - 1 + F.coalesce("k", F.lit(0)))
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    named = joined.join(names, "c").select("k1", "k2", "component_id", *(["n_links"] if more else []))
    out = found.sets.join(named, ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), *more)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, light: int = LIGHT, block: int = BLOCK, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of the similarity join.

    documents (doc_id, n_shingles, component_id, with counts also n_links): one row a row of docs; n_links
    are the other rows of docs that a row links with, its copies among them. links (a, b): every pair of
    different sets that link, once, as the smallest ids of the documents that have them; copies of a set
    aren't expanded. Links of heavy lists are worked out when links is read; counts makes none of them rows.

    A set has the distinct shingles of `width` lower-cased words of the whole text; fewer words are one
    shingle. Null, empty and white texts have the empty set, size 0, and link with nothing: their
    component is their own id. Repeated rows have equal sets and so one component; an id that repeats
    with another text counts as two documents; null ids take part and never become a component_id
    unless a component has no other. Empty tables give empty results; extra columns are ignored.

    Sets are told apart by 128 bits and shingles by 64. The sketch of member frequencies covers all documents.
    """
    found = _joined(docs, id_col, text_col, percent, width, light, block, True)
    of = lambda with_counts: heavy_links(found.source, found.reps, found.labels, found.members, percent, width, with_counts, block)
    documents = _documents(found, staged(link_counts(found.links, found.reps, found.members, of(True)), "jaccard-counts") if counts else None)
    links = light_links(found.links, found.members).union(of(False))
    ids = lambda x: found.reps.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}"))
    return documents, links.join(ids("a"), "a").join(ids("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, whose id is their component's smallest; of rows that repeat id and text one stays."""
    documents = staged(_documents(_joined(docs, id_col, text_col, percent, width, LIGHT, BLOCK, False)), "jaccard-documents")
    first = documents.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(first, docs[id_col].eqNullSafe(first["doc_id"]), "left_semi")
    if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
