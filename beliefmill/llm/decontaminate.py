"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of the templates are joined by hash, so a
question that was asked again with other values still meets its original; along the alignment that the
windows give, every value of the question must then stand for one value of the document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged, tidy
from .shingles import coefficients, window_hashes

#: Words of a window, and how many of them must be no placeholder.
WINDOW, LITERALS = 8, 4
#: An item leaks where windows of one alignment cover so many words, or the whole item if it is shorter.
COVER = 13
#: Bits of the filter that tasks apply before the join; its size is fixed, whatever the benchmark's is.
FILTER_BITS = 1 << 23
#: Kinds of windows.
EXACT, TEMPLATE, NAMED = 0, 1, 2
#: Words that a worker remembers.
REMEMBER = 100_000
#: Words that count as units.
UNITS = frozenset(
    "% mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur mph kmh degree degrees percent".split()
)
#: Words that count as numbers; "one" is no number, since it is mostly a pronoun.
NUMBERS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
)
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_EDGE = "\"'`.,;:!?()[]{}<>*#&$|-_"
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x4E554D0000000010, 0x554E495400000010, 0x4E414D4500000010))
_CAPITAL, _STOP, _NUMERIC, _MEASURE = np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(8)


class Words(dict):
    """The hash of a word's lower-cased form, with flags for a capital, for ending a sentence, for a number and for a unit."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBER:
            self.clear()
        bare = word.strip(_EDGE)
        low = bare.lower()
        code = xxhash.xxh3_64_intdigest(low.encode()) & ~15
        if low in NUMBERS or (bare and _NUMBER.fullmatch(bare)):
            code |= int(_NUMERIC)
        elif low in UNITS:
            code |= int(_MEASURE)
        elif bare[:1].isupper():
            code |= int(_CAPITAL)
        self[word] = code = code | (int(_STOP) if word.rstrip("\"')]}").endswith((".", "!", "?")) else 0)
        return code


def template(text: str | None, seen: Words):
    """(words, codes, exact, slots, capital): codes are hashes of the template's words, exact those of the lower-cased
    words, slots the type of each placeholder or 0; capital tells whether the first word would be a name elsewhere.

    A capitalised word is a name unless it begins the text or a sentence.
    """
    words = text.split() if text else []
    raw = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    exact, slots = raw & ~np.uint64(15), np.zeros(len(words), np.int8)
    codes = exact.copy()
    for flag, code in ((_NUMERIC, _NUM), (_MEASURE, _UNIT)):
        at = (raw & flag) > 0
        codes[at] = code
        slots[at] = 1
    name = (raw[1:] & _CAPITAL).astype(bool) & ~(raw[:-1] & _STOP).astype(bool)
    codes[1:][name] = _NAME
    slots[1:][name] = 2
    return words, codes, exact, slots, bool(len(words) and raw[0] & _CAPITAL)


def short_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` words as window_hashes gives it to a text of so many words."""
    places = np.arange(len(codes) - width + 1)[:, None] + np.arange(width)
    return mix64((codes[places] * coefficients(width, 5 + width)).sum(1, dtype=np.uint64) + np.uint64(width))


def windows(text: str | None, seen: Words, width: int = WINDOW, literals: int = LITERALS, short: tuple = (), item: bool = False):
    """(words, slots, [(size, positions, hashes, kind)]) of a text's windows; a shorter text is one window.

    TEMPLATE windows are those of the template that have enough literal words; EXACT ones are of the
    lower-cased words, for each window with a placeholder (without one, both are the same). `short` are
    lengths below `width` of which windows are made too. A document may hold an item's first word where
    it is taken for a name, so an item has its first window that way too (NAMED). An item of numbers and
    units only has no window.
    """
    words, codes, exact, slots, capital = template(text, seen)
    found: list = []
    if not words or (item and (slots == 1).all()):
        return words, slots, found
    size, filled = min(width, len(words)), bool(slots.any())
    plain = np.concatenate([[0], np.cumsum(slots == 0)])
    for n in {size, *(n for n in short if n <= len(words))}:
        hashed = (lambda c: window_hashes(c, width, 5)) if n == size else (lambda c, n=n: short_hashes(c, n))
        many = plain[n:] - plain[:-n]
        at = np.flatnonzero(many >= min(literals, n))
        found.append((n, at, hashed(codes)[at], TEMPLATE))
        if filled:  # exact
            at = np.flatnonzero(many < n)
            found.append((n, at, hashed(exact)[at], EXACT))
    if item and capital and not slots[0] and plain[size] - 1 >= min(literals, size):
        first = codes[:size].copy()
        first[0] = _NAME
        found.append((size, np.zeros(1, np.int64), window_hashes(first, width, 5), NAMED))
    return words, slots, found


def window_rows(bits, width: int, literals: int, short: tuple, item: bool):
    """(id, k, n_words, n, at, h, kind, slots) for each window of n words, of those that the filter lets through; slots list the placeholders' place and value, none in an exact window."""

    def run(batches):
        seen = Words()
        mask = None if bits is None else bits.value
        for batch in batches:
            rows, values = [], []
            for i, text in enumerate(batch.column(2)):
                words, slots, found = windows(text.as_py(), seen, width, literals, short, item)
                for n, at, h, kind in found:
                    if mask is not None and len(h):
                        bit = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        met = (mask[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                        at, h = at[met], h[met]
                    for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        rows.append((i, len(words), n, a, x, kind))
                        places = [] if kind == EXACT else [*[0][:kind == NAMED], *np.flatnonzero(slots[a:a + n]).tolist()]
                        values.append([f"{j}={words[a + j].strip(_EDGE)}" for j in places])
            cols = np.array(rows, np.int64).reshape(len(rows), 6)
            i = pa.array(cols[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(i), batch.column(1).take(i), *(pa.array(cols[:, c]) for c in (1, 2, 3, 4, 5)), pa.array(values, pa.list_(pa.string()))], names=["id", "k", "n_words", "n", "at", "h", "kind", "slots"])

    return run


def _windows(rows: DataFrame, id_col: str, text_col: str, bits, width: int, literals: int, short: tuple = ()) -> DataFrame:
    text = rows[text_col].cast("string")
    picked = rows.select(rows[id_col].alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(tidy(window_rows(bits, width, literals, short, bits is None)), f"id {kind}, k bigint, n_words bigint, n bigint, at bigint, h bigint, kind bigint, slots array<string>")


def covered(places: Column, width: Column) -> Column:
    """Words that windows of `width` words at the sorted places cover."""
    return F.aggregate(F.transform(places, lambda p, i: F.least(width, F.coalesce(F.get(places, i + 1) - p, width))), F.lit(0).cast("long"), lambda a, x: a + x)


def consistent(found, distinct: bool) -> bool:
    """Whether the (value of the item, value of the document) pairs of windows give each value of the item one value.

    With `distinct`, no two values of the item may have the same one.
    """
    pairs = {p for w in found for p in w[2]}
    return len({a for a, _ in pairs}) == len(pairs) and not (distinct and len({b for _, b in pairs}) < len(pairs))


def words_of(found, n: int) -> int:
    """Words that windows of n words cover."""
    places = sorted({w[0] for w in found})
    return sum(min(n, b - a) for a, b in zip(places, [*places[1:], n + places[-1]], strict=True)) if places else 0


def fitting(found: list, n: int, distinct: bool) -> list:
    """The windows (place, kind, pairs) of an alignment whose values fit.

    Those of a run, in which each window meets or adjoins the next, fit together if every value of the
    item has one value there; a window whose values are all equal to the item's always fits.
    """
    found, runs = sorted(found, key=lambda w: w[0]), []
    for w in found:
        if not runs or w[0] > runs[-1][-1][0] + n:
            runs.append([])
        runs[-1].append(w)
    return [w for run in runs for ok in [consistent(run, distinct)] for w in run if ok or all(a == b for a, b in w[2])]


def judge(distinct: bool):
    """Lines with the words that their fitting windows cover, in all and by the item's template, and whether all values are equal."""

    def run(batches):
        for batch in batches:
            told = []
            for n, found in zip(batch.column("n").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                found = [(w["at"], w["kind"], [(p["a"], p["b"]) for p in w["pairs"]]) for w in found]
                fit = fitting(found, n, distinct)
                told.append((words_of(fit, n), words_of([w for w in fit if w[1] != EXACT], n), all(a == b for w in found for a, b in w[2])))
            cols = list(zip(*told, strict=True)) or [(), (), ()]
            kept = batch.select(["doc_id", "k", "item_id", "item_k", "n_words"])
            more = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "n_covered", "n_loose", "exact"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               width: int = WINDOW, literals: int = LITERALS, cover: int = COVER, inside: bool = False, distinct: bool = True) -> DataFrame:
    """(doc_id, k, item_id, n_covered, n_words, exact) for each document and item that it leaks; k hashes the document's text.

    An item leaks where windows on one alignment (places in the document minus places in the item)
    cover at least `cover` words of it, or all the words that windows cover if it is shorter. Windows
    are of the template, in which every value of the item must stand for one value of the document in each
    run of adjoining windows (with `distinct`, different values for different ones), or of the same words
    in any case. exact: all values are equal. n_covered is the
    best alignment's. Items shorter than a window are found in documents of their length, and with
    `inside` at any place of longer ones. Items with equal texts leak each; null and empty items and
    those of numbers and units only have no window and never leak. Repeated rows and rows of one id and
    text are one document; null ids are kept. Empty tables give an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    items = staged(_windows(benchmark, item_col, item_text_col, None, width, literals), "leak-items")
    bucket = F.col("h").bitwiseAND(FILTER_BITS - 1)
    filled = np.zeros(FILTER_BITS // 64, np.uint64)
    words = items.groupBy(F.shiftright(bucket, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    for r in words.toLocalIterator():  # FILTER_BITS / 64 rows at most
        filled[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    short = tuple(r["n"] for r in items.where(F.col("n") < width).select("n").distinct().collect()) if inside else ()  # width - 1 rows at most
    found = _windows(docs, id_col, text_col, spark.sparkContext.broadcast(filled), width, literals, short).alias("d")
    of = items.alias("i")
    value = lambda x: F.substr(x, F.instr(x, "=") + 1)
    pairs = F.zip_with("i.slots", "d.slots", lambda a, b: F.struct(value(a).alias("a"), value(b).alias("b")))
    met = found.join(of, F.col("d.h") == F.col("i.h")).select(
        F.col("d.id").alias("doc_id"), F.col("d.k").alias("k"), F.col("i.id").alias("item_id"), F.col("i.k").alias("item_k"), F.col("i.n_words").alias("n_words"), F.col("i.n").alias("n"),
        (F.col("d.at") - F.col("i.at")).alias("shift"), F.struct(F.col("i.at").alias("at"), F.col("i.kind").alias("kind"), pairs.alias("pairs")).alias("window"))
    lines = met.groupBy("doc_id", "k", "item_id", "item_k", "n_words", "n", "shift").agg(F.collect_set("window").alias("windows"))
    ids = {c: lines.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    lines = lines.mapInArrow(judge(distinct), f"doc_id {ids['doc_id']}, k bigint, item_id {ids['item_id']}, item_k bigint, n_words bigint, n_covered bigint, n_loose bigint, exact boolean")
    whole = lambda at: F.least(F.lit(cover).cast("long"), covered(F.array_sort(F.collect_set(at)), F.first("n")))
    most = items.groupBy(F.col("id").alias("iid"), F.col("k").alias("ik")).agg(whole(F.col("at")).alias("enough"), whole(F.when(F.col("kind") != EXACT, F.col("at"))).alias("enough_loose"))
    lines = lines.join(most, F.col("item_id").eqNullSafe(F.col("iid")) & (F.col("item_k") == F.col("ik")))
    lines = lines.where((F.col("n_covered") >= F.col("enough")) | ((F.col("n_loose") > 0) & (F.col("n_loose") >= F.col("enough_loose"))))
    return lines.groupBy("doc_id", "k", "item_id").agg(F.max("n_covered").alias("n_covered"), F.max("n_words").alias("n_words"), F.max("exact").alias("exact"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", inside: bool = False, distinct: bool = True) -> DataFrame:
    """The rows of docs, all columns, that leak no item; find_leaks says what the flags do."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, inside=inside, distinct=distinct).select("doc_id", "k").distinct().alias("l")
    rows = docs.alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}").cast("string")) == F.col("l.k"))
    return rows.join(leaks, same, "left_anti")
