"""Running sums with a reset: greedy chunks of rows, also of keys that no single task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import written


def jumps(sums: np.ndarray, budget: int) -> np.ndarray:
    """For each row, if a chunk begins there, the row at which the next one begins; their number where it isn't among them.

    sums: of costs that aren't negative, before the first row and after each. A chunk is closed when it holds
    some cost and the next row would take it beyond the budget; so its first costly row always fits.
    """
    before, own = sums[:-1], sums[1:]
    return np.maximum(np.searchsorted(own, before + budget, "right"), np.minimum(np.searchsorted(own, before, "right") + 1, len(own)))


def last_starts(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the last row that the jumps from each row lead to, how many jumps that takes), by doubling."""
    n = len(to)
    at = np.where(to >= n, np.arange(n), to)
    count = (to < n).astype(np.int64)
    while True:
        more = count[at]
        if not more.any():
            return at, count
        count, at = count + more, at[at]


def blocks(batches):
    """((part, key), columns of the rest) of rows (part, key, …) sorted by both; a block that runs over batches is held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        a = 0
        for b in range(1, len(keys) + 1):
            if b == len(keys) or keys[b] != keys[a]:
                if held and keys[a] != now:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
                a = b
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


class _Block:
    """A key's rows in one range: their running sums, jumps, and where those end."""

    def __init__(self, costs, start: int, budget: int):
        self.sums = np.concatenate([[start], start + np.cumsum(costs.to_numpy())]).astype(np.int64)
        self.to = jumps(self.sums, budget)
        self.end, self.count = last_starts(self.to)

    def threshold(self, row: int, budget: int) -> tuple[int, int]:
        """(sum, 1) where a later range's first row above the sum begins the next chunk; (sum, 0) where the chunk has
        no cost yet, so that this row only is its first costly one."""
        base = int(self.sums[row])
        return (base, 0) if base == int(self.sums[-1]) else (base + budget, 1)


def _links(spans, ends, budget):
    """(part, key, row, to_part, above, hop): where the last starts of a range lead to, in which later range of the key."""

    def run(batches):
        for (part, key), t in blocks(batches):
            b = _Block(t.column(2), spans[part, key], budget)
            parts, sums = ends[key]
            later = int(np.searchsorted(parts, part, "right"))
            rows = np.unique(b.end)
            asked = [b.threshold(int(r), budget) for r in rows]
            above = np.array([a for a, _ in asked], np.int64)
            at = later + np.searchsorted(sums[later:], above, "right")
            some = at < len(parts)
            k = int(some.sum())
            if k:
                kinds = t.schema.types
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, kinds[0]), pa.array([key] * k, kinds[1]), pa.array(rows[some], pa.int64()), pa.array(parts[at[some]], kinds[0]), pa.array(above[some]), pa.array([h for _, h in asked], pa.int32()).filter(pa.array(some))],
                                                 names=["part", "key", "row", "to_part", "above", "hop"])

    return run


def _arrivals(spans, budget):
    """(from_part, from_row, part, key, entry, row, hops, hop): the row at which a link arrives, and the last start from there on."""

    def run(batches):
        for (part, key), t in blocks(batches):
            link = t.column("above").is_valid()
            b = _Block(t.filter(pc.invert(link)).column("cost"), spans[part, key], budget)
            asked = t.filter(link)
            if not asked.num_rows:
                continue
            entry = np.searchsorted(b.sums[1:], asked.column("above").to_numpy(), "right")
            kinds = t.schema.types
            yield pa.RecordBatch.from_arrays([asked.column("from_part").combine_chunks(), asked.column("from_row").combine_chunks(), pa.array([part] * len(entry), kinds[0]), pa.array([key] * len(entry), kinds[1]), pa.array(entry, pa.int64()),
                                              pa.array(b.end[entry], pa.int64()), pa.array(b.count[entry], pa.int64()), asked.column("hop").combine_chunks()], names=["from_part", "from_row", "part", "key", "entry", "row", "hops", "hop"])

    return run


def _numbered(spans, entries, budget):
    """Rows (…) with their chunk."""

    def run(batches):
        for (part, key), t in blocks(batches):
            b = _Block(t.column("cost"), spans.get((part, key), 0), budget)
            before, entry, first = entries.get((part, key), (0, 0, 0))
            chunk = np.full(t.num_rows, before, np.int64)
            at, number = entry, first
            while at < t.num_rows:
                end = int(b.to[at])
                chunk[at:end] = number
                at, number = end, number + 1
            for batch in t.append_column("chunk", pa.array(chunk)).drop_columns(["part"]).to_batches():
                yield batch

    return run


def greedy_chunk_rows(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """(key, order, cost, chunk): the chunk of each row of a key, from 0, in the order of `order`, which repeats no value in a key.

    A chunk is closed when it holds some cost and the next row would take it beyond the budget. Costs are
    whole numbers that aren't negative; rows without one are left out. A null key is a key.

    Rows are dealt to ranges of (key, order). Most keys lie in one range and are chunked there. A key over
    several ranges, even one with most rows, is chunked in all of them at once: for every row that could
    be a range's last start the row where the next chunk would begin is looked up in the later range that
    holds it, and such jumps are doubled until all starts from the key's first row on are known. Only rows
    for ranges, one or two each, reach the driver.
    """
    spread = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(cost).cast("bigint").alias("cost")).where("cost is not null")
    spread = written(spread.repartitionByRange("key", "order").withColumn("part", F.spark_partition_id()).select("part", "key", "order", "cost"), "chunk-ranges")
    totals = spread.groupBy("part", "key").agg(F.sum("cost").alias("total"))
    many = totals.groupBy("key").count().where("count > 1").select("key")
    held = totals.join(many, totals["key"].eqNullSafe(many["key"]), "left_semi").orderBy("part").collect()  # two rows a range at most
    spans, parts, sums = {}, {}, {}
    for r in held:
        k = r["key"]
        start = sums[k][-1] if k in sums else 0
        spans[r["part"], k] = start
        parts.setdefault(k, []).append(r["part"])
        sums.setdefault(k, []).append(start + r["total"])
    entries: dict = {}
    if spans:
        ends = {k: (np.array(parts[k]), np.array(sums[k], np.int64)) for k in parts}
        entries = _entries(spread, spans, parts, ends, budget)
    sorted_ = spread.repartition("part").sortWithinPartitions("part", "key", "order")
    kinds = dict(spread.dtypes)
    found = sorted_.mapInArrow(_numbered(spans, entries, budget), f"key {kinds['key']}, order {kinds['order']}, cost bigint, chunk bigint")
    return found.select(F.col("key").alias(key), F.col("order").alias(order), F.col("cost").alias(cost), "chunk")


def _entries(spread: DataFrame, spans: dict, parts: dict, ends: dict, budget: int) -> dict:
    """Of each range of a key over several: the chunk of rows before its first start, that start, and its chunk."""
    spark = spread.sparkSession
    kinds = dict(spread.dtypes)
    which = spark.createDataFrame([(p, k) for p, k in spans], f"p int, k {kinds['key']}")
    rows = written(spread.join(F.broadcast(which), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).drop("p", "k"), "chunk-spans")  # two rows a range at most
    by = rows.select("part", "key", "cost", "order").repartition("part", "key").sortWithinPartitions("part", "key", "order")
    links = by.select("part", "key", "cost").mapInArrow(_links(spans, ends, budget), f"part int, key {kinds['key']}, row bigint, to_part int, above bigint, hop int")
    asked = links.select(F.col("to_part").alias("part"), "key", "above", "hop", F.col("part").alias("from_part"), F.col("row").alias("from_row"))
    both = rows.unionByName(asked, allowMissingColumns=True).repartition("part", "key").sortWithinPartitions("part", "key", F.col("above").isNotNull(), "order")
    shape = f"from_part int, from_row bigint, part int, key {kinds['key']}, entry bigint, row bigint, hops bigint, hop int"
    met = both.select("part", "key", "cost", "above", "hop", "from_part", "from_row").mapInArrow(_arrivals(spans, budget), shape)
    # chunk: how many chunks a jump goes on by; count: those from the last jump's arrival to the range's last start
    jump = written(met.select("key", "from_part", "from_row", "part", "row", "entry", "hop", "hops", (F.col("hop") + F.col("hops")).alias("chunk")), "chunk-jumps")
    first = spark.createDataFrame([(k, -1, 0, p[0]) for k, p in parts.items()], f"key {kinds['key']}, hop int, entry bigint, part int")
    lead = rows.join(F.broadcast(first.select(F.col("key").alias("k"), F.col("part").alias("p"))), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).drop("p", "k")
    lead = lead.select("part", "key", "cost", "order").repartition("part", "key").sortWithinPartitions("part", "key", "order")
    starts = lead.select("part", "key", "cost").mapInArrow(_leads(budget), f"part int, key {kinds['key']}, row bigint, hops bigint")
    known = written(starts.select("key", "part", "row", F.lit(0).cast("bigint").alias("entry"), F.lit(1).alias("hop"), "hops", F.col("hops").alias("at")), "chunk-known")
    for _ in range(max(len(p) for p in parts.values()).bit_length() + 1):
        a, b = known.alias("a"), jump.alias("b")
        on = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.part") == F.col("b.from_part")) & (F.col("a.row") == F.col("b.from_row"))
        new = a.join(b, on).select("b.key", "b.part", "b.row", "b.entry", "b.hop", "b.hops", (F.col("a.at") + F.col("b.chunk")).alias("at"))
        known = written(known.union(new).dropDuplicates(["key", "part"]), "chunk-known")
        c, d = jump.alias("c"), jump.alias("d")
        on = F.col("c.key").eqNullSafe(F.col("d.key")) & (F.col("c.part") == F.col("d.from_part")) & (F.col("c.row") == F.col("d.from_row"))
        jump = written(c.join(d, on).select("c.key", "c.from_part", "c.from_row", "d.part", "d.row", "d.entry", "d.hop", "d.hops", (F.col("c.chunk") + F.col("d.chunk")).alias("chunk")), "chunk-jumps")
    at = {(r["part"], r["key"]): r for r in known.collect()}  # one row a range and key at most
    entries = {}
    for key, own in parts.items():
        last = 0
        for part in own:
            r = at.get((part, key))
            if r is None:
                entries[part, key] = last, 1 << 62, 0
                continue
            first_ = r["at"] - r["hops"]
            entries[part, key] = (first_ - 1 if r["hop"] else first_), r["entry"], first_
            last = r["at"]
    return entries


def _leads(budget):
    """(part, key, row, hops): the last start of the range where a key begins."""

    def run(batches):
        for (part, key), t in blocks(batches):
            b = _Block(t.column(2), 0, budget)
            kinds = t.schema.types
            yield pa.RecordBatch.from_arrays([pa.array([part], kinds[0]), pa.array([key], kinds[1]), pa.array([int(b.end[0])], pa.int64()), pa.array([int(b.count[0])], pa.int64())], names=["part", "key", "row", "hops"])

    return run
