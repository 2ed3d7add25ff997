"""Corpus files of any size: one JSON object that many tasks read, each from where the text source starts it."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import written

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
#: Bytes that are scanned at once, since a scan holds some hundred bytes for each; rows that are taken from a batch at once.
PIECE, ROWS = 1 << 18, 500


@dataclass
class State:
    """Where a scan of JSON text stands: in a string, after a backslash there, how deep, and the last byte that isn't white."""

    inside: bool = False
    escape: bool = False
    depth: int = 0
    last: int = 0


def marks(data: np.ndarray, at: State):
    """(opening quotes, structure, depth after each byte, previous byte that isn't white) of a stretch; `at` moves on to its end.

    structure: bytes outside strings.
    """
    i = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data == 92, -1, i))  # the last byte that is no backslash
    before = np.concatenate([[-1], plain[:-1]])
    slashes = i - 1 - before + np.where(before < 0, int(at.escape), 0)
    quotes = (data == 34) & (slashes % 2 == 0)
    inside = (np.cumsum(quotes) - quotes + int(at.inside)) % 2 == 1
    steps = np.where(inside, 0, _STEP[data]).astype(np.int64)
    depth = at.depth + np.cumsum(steps)
    seen = np.maximum.accumulate(np.where(_WHITE[data], -1, i))
    prior = np.concatenate([[-1], seen[:-1]])
    previous = np.where(prior < 0, at.last, data[prior])
    if len(data):
        at.escape = bool((slashes[-1] + 1) % 2) if data[-1] == 92 else False
        at.inside = bool(inside[-1] ^ quotes[-1])
        at.depth = int(depth[-1])
        if seen[-1] >= 0:
            at.last = int(data[seen[-1]])
    return quotes & ~inside, ~inside, depth, previous


@dataclass
class Split:
    """What a task's stretch of the object holds, besides the records that lie in it whole."""

    keys: int = 0  # names at depth 2
    sections: list = field(default_factory=list)  # (names at depth 2 before it, name at depth 1)
    head: list = field(default_factory=list)  # text up to the first name or end of a record
    ended: bool = False  # whether there is such a place
    tail: list | None = None  # text of a record that isn't over at the end


class Scanner:
    """Finds the members of members of an object, stretch by stretch."""

    def __init__(self, at: State):
        self.at, self.split, self.name = at, Split(), None

    def feed(self, raw: bytes):
        """The (number, text) of records that end in this stretch."""
        data = np.frombuffer(raw, np.uint8)
        opening, structure, depth, previous = marks(data, self.at)
        named = opening & ((previous == ord("{")) | (previous == ord(",")))
        key = named & (depth == 2)
        over = structure & (((data == ord(",")) & (depth == 2)) | ((data == ord("}")) & (depth == 1)))
        top = (named & (depth == 1)) | (structure & (data == ord(":")) & (depth == 1))
        s, begin = self.split, 0
        for i in np.flatnonzero(key | over | top).tolist():
            if top[i]:
                if named[i]:
                    self.name = i, []
                elif self.name is not None:
                    s.sections.append((s.keys, json.loads(b"".join([*self.name[1], raw[self.name[0]:i]]))))
                    self.name = None
            elif key[i]:
                if not s.ended:
                    s.head.append(raw[begin:i])
                    s.ended = True
                s.tail, begin = [], i
                s.keys += 1
            else:
                if not s.ended:
                    s.head.append(raw[begin:i])
                    s.ended = True
                elif s.tail is not None:
                    yield s.keys - 1, b"".join([*s.tail, raw[begin:i]])
                s.tail = None
        if self.name is not None:
            self.name[1].append(raw[self.name[0]:])
            self.name = 0, self.name[1]
        if not s.ended:
            s.head.append(raw[begin:])
        elif s.tail is not None:
            s.tail.append(raw[begin:])


def member(text: str) -> tuple[str, str]:
    """(name, value) of `"name": value`, the value as it is written."""
    name, end = json.JSONDecoder().raw_decode(text)
    return name, text[end:].lstrip().removeprefix(":").strip()


def _pieces(batches):
    """((file, at), bytes) of rows (file, at, value), with the brackets that parted values: pieces of about PIECE bytes at most."""
    key, held, size = None, [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            for file, at, value in zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns[:3]), strict=True):
                raw = f"{value}}}".encode()
                if held and ((file, at) != key or size + len(raw) > PIECE):
                    yield key, b"".join(held)
                    held, size = [], 0
                key, last = (file, at), (len(raw) - 1) // PIECE * PIECE
                for begin in range(0, last, PIECE):
                    yield key, raw[begin:begin + PIECE]
                held.append(raw[last:])
                size += len(raw) - last
    if held:
        yield key, b"".join(held)


def _stretches(batches):
    """The pieces (file, at), bytes, and whether each is its stretch's last one."""
    held = None
    for key, raw in _pieces(batches):
        if held is not None:
            yield *held, held[0] != key
        held = key, raw
    if held is not None:
        yield *held, True


def _summaries(batches):
    """(file, at, size, and after both beginnings: inside, depth, and the last byte) of each stretch."""
    ways, size = [State(), State(inside=True)], 0
    for (file, at), raw, final in _stretches(batches):
        data = np.frombuffer(raw, np.uint8)
        size += len(raw)
        for w in ways:
            marks(data, w)
        if final:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, at, size, [w.inside for w in ways], [w.depth for w in ways], ways[0].last)], names=["file", "at", "size", "inside", "depth", "last"])
            ways, size = [State(), State(inside=True)], 0


def _members(entries, spurious):
    """Rows of each stretch: kind 0, its records whole (n, text); 1 what it says of sections; 2 its head; 3 its tail."""

    def run(batches):
        scan = None
        for key, raw, final in _stretches(batches):
            if scan is None:
                order, state = entries[key]
                scan = Scanner(State(**vars(state)))
            if final and key in spurious:
                raw = raw[:-1]
            rows = [(order, 0, n, t.decode(), None) for n, t in scan.feed(raw)]
            if final:
                s = scan.split
                rows.append((order, 1, s.keys, None, json.dumps([s.sections, s.ended, s.tail is not None])))
                rows.append((order, 2, None, b"".join(s.head).decode(), None))
                if s.tail is not None:
                    rows.append((order, 3, s.keys - 1, b"".join(s.tail).decode(), None))
                scan = None
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["split", "kind", "n", "text", "about"])

    return run


def _named(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            met = [member(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in met], pa.string()), pa.array([m[1] for m in met], pa.string())], names=["bn_pos", "id", "record"])


def read_members(spark: SparkSession, path: str, section: str = "bayesian_networks") -> DataFrame:
    """(bn_pos, id, record) of {"…": …, section: {id: record, …}}, in order; records as they are written.

    path: a file, or a folder whose files follow one another by name; together they are one object, or
    several. The text source cuts files at closing brackets into stretches for its tasks, whatever their lines
    are. A first pass finds, for each stretch, how it ends when it begins inside a string and when not, and
    how much deeper; so each stretch's beginning is known, and a second pass takes out the records. Those
    that lie in several stretches are put together. Only a row a stretch reaches the driver.

    Text is UTF-8; names at the top hold no closing bracket. An id that is repeated gives a row each time.
    An empty section, or none, gives no rows.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    total = F.col("_metadata.file_size").alias("total")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", total)
    sizes = {r["file"]: r["total"] for r in rows.select("file", "total").distinct().collect()}
    rows = rows.drop("total")
    told = rows.mapInArrow(_summaries, "file string, at bigint, size bigint, inside array<boolean>, depth array<bigint>, last bigint").collect()
    entries, spurious, now, seen = {}, set(), State(), Counter()
    told = sorted(told, key=lambda r: (r["file"], r["at"]))
    for r in told:
        seen[r["file"]] += r["size"]
    for order, r in enumerate(told):
        key = r["file"], r["at"]
        entries[key] = order, now
        way = int(now.inside)
        now = State(r["inside"][way], False, now.depth + r["depth"][way], r["last"])
        if order + 1 == len(told) or told[order + 1]["file"] != r["file"]:
            # a file whose last bracket isn't its end has one bracket less than stretches were closed with
            if seen[r["file"]] > sizes[r["file"]]:
                spurious.add(key)
                now.depth += 1
    found = written(rows.mapInArrow(_members(entries, spurious), "split bigint, kind int, n bigint, text string, about string"), "corpus-members")
    about = sorted(found.where("kind = 1").select("split", "n", "about").collect())
    # of each stretch: ranges (first number, last number, position less number) of names in the section; the stretch that its head goes on from
    ranges, owner, place, inside, open_ = [], [], 0, False, None
    for split, keys, told_ in about:
        sections, ended, tail = json.loads(told_)
        if open_ is not None:
            owner.append((split, open_))
        at = 0
        for n, name in [*sections, (keys, None)]:
            if inside and n > at:
                ranges.append((split, at, n, place - at))
                place += n - at
            at = n
            if name is not None:
                inside = name == section
        open_ = split if tail else None if ended else open_
    parts = found.where("kind in (2, 3)")
    heads = parts.where("kind = 2").join(spark.createDataFrame(owner, "split bigint, owner bigint"), "split")
    tails = parts.where("kind = 3").withColumn("owner", F.col("split"))
    pieces = heads.unionByName(tails).groupBy("owner").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("split", F.struct((-F.col("kind")).alias("k"), "text").alias("x")))).alias("p"))
    joined = pieces.select(F.col("owner").alias("split"), "n", F.array_join(F.transform("p", lambda x: x["x"]["text"]), "").alias("text"))
    whole = found.where("kind = 0").select("split", "n", "text").unionByName(joined)
    where = spark.createDataFrame(ranges, "split bigint, low bigint, high bigint, shift bigint")
    met = whole.join(where, "split").where("n >= low and n < high")
    return met.select((F.col("n") + F.col("shift")).alias("bn_pos"), "text").mapInArrow(_named, "bn_pos bigint, id string, record string")
