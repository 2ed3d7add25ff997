"""Repeated-window removal by a depth-limited radix sort of suffixes.

Suffixes are ordered only through `width` bytes, most significant digit first, and a suffix leaves as
soon as its group has one member. The first digit is a 64-byte gram that every window of `width` bytes
selects from its own content (its smallest hashed gram, the leftmost of equals), with the window's
offset from it: equal windows select the same gram at the same offset, and one row stands for all the
suffixes that select it. The later digits are the two halves of the window. Groups that are still equal
after the last digit are exactly the windows that occur more than once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, prefix_sums, staged, tidy

#: Bytes of the first digit.
GRAM = 64
#: Bytes of texts that are hashed at a time; longer texts are cut into overlapping pieces.
CHUNK = 1 << 20
#: Members of a gram's group that one task orders in memory; larger groups are ordered by shuffles.
BLOCK = 8192
#: Bytes of context that one pass over several groups orders at a time.
PASS_BYTES = 1 << 20
_POS = np.uint64((1 << 28) - 1)


def span_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes that start at each position, as long as they fit."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    total = prefix_sums(data)
    return mix64((total[width:] - total[:n - width + 1]) * powers(n)[1][:n - width + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int):
    """(gram hash, position, smallest offset, largest offset) of the grams that windows of the pieces [begin, end) select."""
    grams = span_hashes(data, GRAM)
    if len(data) < width:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, width - GRAM + 1) & _POS).astype(np.int64)
    starts = np.concatenate([np.arange(b, e - width + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    pos = at[first]
    return grams[pos], pos, pos - starts[last], pos - starts[first]


def anchor_rows(width: int):
    """(h, id, k, places) for each gram that a text selects; a place packs position, smallest and largest offset.

    Places of one gram in a piece share a row, so a text that repeats itself sends few rows.
    """

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            piece: list = []
            size = 0

            def flush():
                data = np.frombuffer(b"".join(p[2] for p in piece), np.uint8)
                lengths = np.array([len(p[2]) for p in piece])
                ends = np.cumsum(lengths)
                h, pos, lo, hi = anchors(data, ends - lengths, ends, width)
                of = np.searchsorted(ends, pos, "right")
                row = np.array([p[0] for p in piece])[of]
                place = ((pos - (ends - lengths)[of] + np.array([p[1] for p in piece])[of]) << 16) | (lo << 8) | hi
                order = np.lexsort((h, row))
                h, row, place = h[order], row[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                ends = np.append(first, len(h)).astype(np.int32) * 8
                places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(place.astype("<i8").tobytes())])
                return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), batch.column(0).take(pa.array(row[first])), pa.array(keys[row[first]]), places], names=["h", "id", "k", "places"])

            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                n = len(raw) if raw is not None else 0
                for at in range(0, max(0, n - width + 1), CHUNK):
                    part = memoryview(raw)[at:min(n, at + CHUNK + width - 1)]
                    if size + len(part) > CHUNK and piece:
                        yield flush()
                        piece, size = [], 0
                    piece.append((i, at, part))
                    size += len(part)
            if piece:
                yield flush()

    return run


def repeated_rows(block: int):
    """The (id, k, places, hot) of the rows (h, id, k, places), sorted by h, whose h has several places. At most `block` rows are held."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key, rows, places = None, 0, 0

        def out(batch, hot):
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(batch.num_rows, hot))], names=["id", "k", "places", "hot"])

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(starts, len(h)))
            count = np.add.reduceat(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) // 8, starts)
            low = 0
            if key is not None and h[0] == key:  # the first group goes on with the last batch's
                rows, places, low = rows + int(sizes[0]), places + int(count[0]), 1
                held.append(batch.slice(0, int(sizes[0])))
                if rows > block:
                    yield from (out(b, True) for b in held)
                    held = []
            if low < len(starts):
                if held and places > 1:
                    yield from (out(b, False) for b in held)
                keep = np.repeat(count > 1, sizes)
                keep[:starts[low]] = False
                keep[starts[-1]:] = False
                for flag in (False, True):
                    some = np.flatnonzero(keep & (np.repeat(sizes > block, sizes) == flag))
                    if len(some):
                        yield out(batch.take(pa.array(some)), flag)
                key, rows, places = h[-1], int(sizes[-1]), int(count[-1])
                held = [batch.slice(int(starts[-1]))]
                if rows > block:
                    yield out(held[0], True)
                    held = []
        if held and places > 1:
            yield from (out(b, False) for b in held)

    return run


def context_rows(width: int):
    """(h, c, id, k, begins, bytes) for each context of each text: the bytes of all windows that select a gram at a place.

    Equal contexts of a text share a row; begins list where they start, with the gram's largest offset.
    """

    def run(batches):
        for batch in batches:
            text, places, keys = batch.column(2), batch.column(3), batch.column(1)
            rows: list = []
            for i in range(batch.num_rows):
                raw = text[i].as_buffer().to_pybytes()
                p = np.sort(np.frombuffer(b"".join(places[i].as_py()), "<i8"))
                pos, lo, hi = p >> 16, (p >> 8) & 255, p & 255
                first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))  # pieces of a long text may give a place in two parts
                lo, hi, pos = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), pos[first]
                found: dict = {}
                for a, o, b in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    c = raw[a - b:a - o + width]
                    found.setdefault((b, c), []).append((a - b) << 8 | b)
                for (b, c), begins in found.items():
                    rows.append((xxhash.xxh3_64_intdigest(c[b:b + GRAM]), xxhash.xxh3_64_intdigest(c, seed=b), i, np.array(begins, "<i8").tobytes(), c))
                if len(rows) > 8000:
                    yield pack(batch, keys, rows)
                    rows = []
            if rows:
                yield pack(batch, keys, rows)

    def pack(batch, keys, rows):
        h, c, i, begins, contexts = zip(*rows, strict=True)
        i = pa.array(i, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)), batch.column(0).take(i), keys.take(i),
                                           pa.array(begins, pa.binary()), pa.array(contexts, pa.binary())], names=["h", "c", "id", "k", "begins", "bytes"])

    return run


def window_digits(group: np.ndarray, high: np.ndarray, contexts: list[bytes], width: int):
    """For each window of the contexts: its context, its start there, and two digits that equal windows share.

    The digits are the halves of the window; the group (of the gram) and the offset go into both.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    base, half = np.cumsum(lengths) - lengths, width // 2
    counts = lengths - width + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[of] + inside
    left, right = span_hashes(data, half), span_hashes(data, width - half)
    place = mix64(group[of] * np.uint64(0xD6E8FEB86659FD93) + (high[of] - inside).astype(np.uint64) + np.uint64(1))
    return of, inside, mix64(left[at] ^ place), mix64(right[at + half] + place)


def equal_windows(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which windows stay in a group of two or more through both digits."""
    repeated = np.zeros(len(first), bool)
    order = np.argsort(first, kind="stable")
    x = first[order]
    same = x[1:] == x[:-1]
    left = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(x) else order
    order = left[np.lexsort((second[left], first[left]))]
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    if len(order):
        repeated[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] = True
    return repeated


def runs(of: np.ndarray, inside: np.ndarray, repeated: np.ndarray):
    """(context, first start, last start) of each maximal run of repeated windows."""
    w = np.flatnonzero(repeated)
    if not len(w):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (of[w][1:] != of[w][:-1]) | (inside[w][1:] != inside[w][:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    return of[w][first], inside[w][first], inside[w][last]


def ordered_groups(width: int):
    """(id, k, begins, lo, hi) from context rows sorted by (h, c): removed are the bytes begin + lo to begin + hi.

    Whole groups of light grams are ordered, many at a time.
    """

    def work(table: pa.Table):
        h, c = (table.column(i).to_numpy() for i in (0, 1))
        times = pc.binary_length(table.column(4)).to_numpy() // 8
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        context = np.cumsum(new) - 1  # of each row; equal contexts are ordered once
        lead = np.flatnonzero(new)
        group = np.cumsum(np.concatenate([[True], h[lead][1:] != h[lead][:-1]])).astype(np.uint64)
        some = table.take(pa.array(lead))
        high = np.array([b[0] for b in some.column(4).to_pylist()], np.int64)  # the lowest byte of the first begin
        of, inside, one, two = window_digits(group, high, some.column(5).to_pylist(), width)
        repeated = equal_windows(one, two) | (np.bincount(context, times) > 1)[of]
        r, lo, hi = runs(of, inside, repeated)
        each = np.bincount(r, minlength=len(lead))
        rows = np.flatnonzero(each[context])
        ends = np.concatenate([[0], np.cumsum(each[context[rows]])]).astype(np.int32)
        which = np.repeat((np.cumsum(each) - each)[context[rows]] - ends[:-1], each[context[rows]]) + np.arange(ends[-1])
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[which])) for x in (lo, hi + width)]
        kept = table.take(pa.array(rows)).combine_chunks()
        return [pa.RecordBatch.from_arrays([*(kept.column(i).combine_chunks() for i in (2, 3, 4)), *lists], names=["id", "k", "begins", "lo", "hi"])] if len(rows) else []

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                held.append(some)
                size += some.nbytes
                if size < PASS_BYTES:
                    continue
                h = some.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                rest = some.slice(cut)
                if cut == 0 and len(held) > 1 and held[-2].column(0)[-1].as_py() == h[-1]:
                    continue
                held[-1] = some.slice(0, cut)
                if any(b.num_rows for b in held):
                    yield from work(pa.Table.from_batches([b for b in held if b.num_rows]))
                held, size = [rest], rest.nbytes
        if any(b.num_rows for b in held):
            yield from work(pa.Table.from_batches([b for b in held if b.num_rows]))

    return run


def digit_rows(width: int):
    """(one, two, h, c, inside) for each window of the contexts (h, c, begins, bytes) of hot grams."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                h, c = (some.column(i).to_numpy() for i in range(2))
                high = np.array([b[0] for b in some.column(2).to_pylist()], np.int64)
                of, inside, one, two = window_digits(h.view(np.uint64), high, some.column(3).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(h[of]), pa.array(c[of]), pa.array(inside)], names=["one", "two", "h", "c", "inside"])

    return run


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes: spans that overlap or touch become one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[first].tolist(), reach[np.append(first[1:], len(starts)) - 1].tolist(), strict=True))


def expand_spans(found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans (begins, lo, hi): every run at every begin."""
    parts = [(np.frombuffer(x["begins"], "<i8") >> 8, np.array(x["lo"], np.int64), np.array(x["hi"], np.int64)) for x in found]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + [(b[:, None] + p[i]).ravel() for b, *p in parts]) for i in (0, 1))


def cut_rows(batches):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) from (id, text bytes, spans)."""
    for batch in batches:
        out = []
        for raw, found in zip(batch.column(1), batch.column(2), strict=True):
            data = raw.as_buffer().to_pybytes()
            spans = merge_spans(*expand_spans(found.as_py() or []))
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (id, k, raw) has a row a row of docs, spans (id, k, begins, lo, hi) covers, overlapping, all repeated bytes."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("raw"))
    kind = texts.schema["id"].dataType.simpleString()
    selected = texts.mapInArrow(tidy(anchor_rows(width)), f"h bigint, id {kind}, k bigint, places binary").repartition("h").sortWithinPartitions("h")
    alive = staged(selected.mapInArrow(repeated_rows(block), f"id {kind}, k bigint, places binary, hot boolean"), "suffix-alive")

    def contexts(hot: bool):
        places = alive.where("hot" if hot else "not hot").groupBy("id", "k").agg(F.collect_list("places").alias("places")).alias("p")
        t = texts.alias("t")
        met = t.join(places, F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.k") == F.col("p.k"))).select("t.id", "t.k", "raw", "places")
        return met.mapInArrow(context_rows(width), f"h bigint, c bigint, id {kind}, k bigint, begins binary, bytes binary")

    light = contexts(False).repartition("h").sortWithinPartitions("h", "c")
    spans = light.mapInArrow(tidy(ordered_groups(width)), f"id {kind}, k bigint, begins binary, lo array<bigint>, hi array<bigint>")
    if not alive.where("hot").isEmpty():
        # one plan with the light grams: texts are dealt by id once, and every part reads that exchange
        rows = contexts(True)
        distinct = rows.groupBy("h", "c").agg(F.sum(F.length("begins") / 8).alias("n"), F.first("begins").alias("begins"), F.first("bytes").alias("bytes"))
        digits = distinct.select("h", "c", "begins", "bytes").mapInArrow(digit_rows(width), "one bigint, two bigint, h bigint, c bigint, inside bigint")
        met = digits.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        found = digits.join(met, ["one", "two"]).groupBy("h", "c").agg(F.collect_set("inside").alias("met"))
        everything = F.sequence(F.lit(0).cast("long"), (F.length("bytes") - width).cast("long"))
        found = distinct.join(found, ["h", "c"], "left").select("h", "c", F.array_sort(F.when(F.col("n") > 1, everything).otherwise(F.col("met"))).alias("met"))
        ends = lambda step: F.filter("met", lambda x: ~F.array_contains("met", x + step))
        found = found.where("met is not null").select("h", "c", ends(-1).alias("lo"), F.transform(ends(1), lambda x: x + width).alias("hi"))
        spans = spans.union(rows.select("h", "c", "id", "k", "begins").join(found, ["h", "c"]).select("id", "k", "begins", "lo", "hi"))
    return texts, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, block: int = BLOCK) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are whole and count as UTF-8 bytes. A byte is removed if a string of `width` bytes that covers
    it starts anywhere else too, in another row or the same one, overlapping or not; no match crosses
    rows. Null texts count as empty; texts shorter than `width` keep all; repeated rows are texts of
    their own and repeat each other; null ids are kept. Empty tables give empty results; extra columns
    are ignored.
    """
    if not GRAM < width <= GRAM + 255:
        raise ValueError(f"width must be over {GRAM} and at most {GRAM + 255}")  # offsets in a window take 8 bits
    texts, spans = repeated_spans(docs, id_col, text_col, width, block)
    kind = texts.schema["id"].dataType.simpleString()
    of = spans.groupBy("id", "k").agg(F.collect_list(F.struct("begins", "lo", "hi")).alias("spans")).alias("s")
    t = texts.alias("t")
    met = t.join(of, F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.k") == F.col("s.k")), "left").select("t.id", "raw", "spans")
    return met.mapInArrow(tidy(cut_rows), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
