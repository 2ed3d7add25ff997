"""Token-ID output with Re-Pair grammar compression.

Documents go in ascending id order into shards. A shard's ids are compressed by replacing frequent
pairs of neighbours by nonterminals, round by round, until no pair is frequent; the rules and the lengths that symbols expand to
are stored with it, so any position can be decoded without decoding what stands before it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, tidy

#: Ids after which a shard is closed; a document is never cut, so one may be longer.
SHARD_IDS = 1 << 19
#: A pair with fewer occurrences, of which no two overlap, isn't replaced.
LEAST = 8
#: Symbols between two entries of a shard's position index.
INDEX_STEP = 1024
#: Words that a worker remembers; beyond that it starts anew.
REMEMBER = 300_000
#: Characters after which a group of texts is closed, for encoding; a text is never cut.
GROUP_CHARS = 1 << 21
#: The settings of the lower-casing word vocabulary, for which words are looked up one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_UPPER = bytes([*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
_LOWER = bytes.maketrans(_UPPER, bytes(b + 32 for b in _UPPER))
_SAFE = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTOR = 0x9E3779B97F4A7C15
_WORKER: dict = {}


def latin_words() -> re.Pattern:
    """WORD_PATTERN or an end of line, for Latin-1 bytes: its classes are written out by the characters' categories."""
    of = lambda kind: "".join(f"\\x{b:02x}" for b in range(256) if unicodedata.category(chr(b))[0] == kind)
    return re.compile(WORD_PATTERN.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")).encode() + rb"|\n")


_WORDS = latin_words()


def byte_signs() -> str:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class Words(dict):
    """Ids of the tokenizer's words, as bytes; its model is asked once for each."""

    def __init__(self, model, size: int):
        super().__init__()
        self.tokenize, self.signs = model.tokenize, dict(enumerate(byte_signs()))
        self.coded = [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        if not word.isascii():
            text = text.encode().decode("latin-1").translate(self.signs)
        found = self.tokenize(text)
        self[word] = ids = self.coded[found[0].id] if len(found) == 1 else b"".join([self.coded[t.id] for t in found])
        return ids


def taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin at begin[k] and are size[k] long, for each k of `of`, one after another."""
    many = size[of]
    return flat[np.arange(many.sum()) + np.repeat(begin[of] - (np.cumsum(many) - many), many)]


def word_by_word(tokenizer) -> bool:
    """Whether a tokenizer has the word vocabulary's settings and no added token without "<|"."""
    told = lambda step: step and json.loads(step.__getstate__())
    if told(tokenizer.normalizer) != NORMALIZER or told(tokenizer.pre_tokenizer) != PRE_TOKENIZER or tokenizer.truncation:
        return False
    model = tokenizer.model
    plain = type(model).__name__ == "BPE" and not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.byte_fallback)
    return plain and all("<|" in x.content for x in tokenizer.get_added_tokens_decoder().values())


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, from ids of their words.

    The word vocabulary's tokenizer lower-cases a text, cuts it into words that never cross white space,
    and gives each word ids of its own. Texts of printable Latin-1 are cut here by the same pattern, a
    group of texts at a time: what stands between white space is told apart first, then the words in it,
    and both are worked out once each. All other texts, and those for a tokenizer with other settings,
    are given to it whole.
    """

    def __init__(self, tokenizer, by_word: bool):
        self.tokenizer, self.by_word = tokenizer, by_word
        self.words = Words(self.tokenizer.model, self.tokenizer.get_vocab_size())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        raws = [self.plain(text) for text in texts]
        found = iter(self.of_plain([raw for raw in raws if raw is not None]))
        return [self.whole(text) if raw is None else next(found) for text, raw in zip(texts, raws, strict=True)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def plain(self, text: str) -> bytes | None:
        """The lower-cased bytes of a text of printable Latin-1; none if it may hold a special token."""
        if not self.by_word or "<|" in text:
            return None
        try:
            raw = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _SAFE) else raw

    def of_plain(self, raws: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join([b"", *raws, b""]), np.uint8)
        solid = ~_SPACE[data]
        turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # data begins and ends with white space
        begin = turn[::2]
        if not len(begin):
            return [np.zeros(0, "<u4")] * len(raws)
        place = np.append(0, np.cumsum(turn[1::2] - begin))
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(place), pa.py_buffer(data[solid])]).dictionary_encode()
        part = parts.indices.to_numpy()
        told = parts.dictionary
        flat, ends = self.of_lines(np.insert(np.frombuffer(told.buffers()[2], np.uint8), np.frombuffer(told.buffers()[1], np.int64)[1:], 10).tobytes())
        size = np.diff(ends, prepend=0)
        ids = taken(flat, ends - size, size, part)
        stop = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        cuts = np.append(0, np.cumsum(size[part]))[np.searchsorted(begin, stop)]
        return np.split(ids, cuts[:-1])

    def of_lines(self, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lines, where those of each end)."""
        if len(self.words) >= REMEMBER:
            self.words.clear()
        found = _WORDS.findall(lines)
        place = {word: k for k, word in enumerate(dict.fromkeys(found))}
        word = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
        known = [b"" if w == b"\n" else self.words[w] for w in place]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = taken(np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, size, word)
        return flat, np.cumsum(size[word])[word == place[b"\n"]]


def encoder(path: str) -> Encoder:
    """A worker keeps the tokenizer and what it remembers of words, for its next tasks hold mostly the same ones."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _WORKER[path] = Encoder(tokenizer, word_by_word(tokenizer))
    return _WORKER[path]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distinct, counts): the distinct keys with LEAST occurrences or more, and for each key its place there, or -1.

    Keys are counted by hash; those that share a slot with another one are hashed again, until all are told apart.
    """
    ids, found, counts, left, n, factor = np.full(len(keys), -1, np.int32), [keys[:0]], [np.zeros(0, np.int64)], None, 0, _FACTOR
    bits = max(10, min(18, len(keys).bit_length()))
    while True:
        some = keys if left is None else keys[left]
        slot = ((some * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
        full = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= LEAST)[slot])
        if not len(full):
            return ids, np.concatenate(found), np.concatenate(counts)
        slot, some, left = slot[full], some[full], full if left is None else left[full]
        holder = np.zeros(1 << bits, np.uint64)
        holder[slot] = some
        same = holder[slot] == some
        count = np.bincount(slot[same], minlength=1 << bits)
        good = np.flatnonzero(count >= LEAST)
        number = np.full(1 << bits, -1, np.int32)
        number[good] = np.arange(n, n + len(good))
        ids[left[same]] = number[slot[same]]
        found.append(holder[good])
        counts.append(count[good])
        n, left, factor = n + len(good), left[~same], factor * _FACTOR % (1 << 64)


def repair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a sequence of ids below `base`; rule k is the pair that symbol base + k stands for.

    Each round counts all pairs exactly and replaces an occurrence if its pair is more frequent than those
    that overlap it; of a run of one symbol, every second pair from the left counts. A pair that would be
    replaced fewer than LEAST times waits for the next round. Rounds end when no pair occurs LEAST times;
    the most frequent one is replaced in each, so they do end. Counts of a pair never grow after the round
    that made its symbols, so a round looks only at pairs that were frequent or are new.
    """
    seq, n = ids.astype(np.uint32), len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    at, alive, rules, count = np.arange(max(n - 1, 0)), np.ones(n, bool), [np.zeros(0, np.uint64)], 0
    while len(at) >= LEAST:
        a, b = seq[at], seq[after[at]]
        keys = (a.astype(np.uint64) << np.uint64(32)) | b
        touch = after[at[:-1]] == at[1:]
        twin = np.flatnonzero(a == b)
        run = np.concatenate([[True], (np.diff(twin) != 1) | ~touch[twin[:-1]]])[:len(twin)]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(twin)), 0))
        second = twin[(np.arange(len(twin)) - begin) % 2 == 1]
        first = np.delete(np.arange(len(at)), second) if len(second) else slice(None)
        of = np.full(len(at), -1, np.int32)
        of[first], pairs, often = numbered(keys[first])
        if not len(pairs):
            break
        rank = np.full(len(pairs) + 1, -1, np.int32)  # the last is that of place -1
        rank[np.lexsort((pairs * np.uint64(_FACTOR), often))] = np.arange(len(pairs))
        level = rank[of]
        use = level >= 0
        keep = use.copy()
        keep[second] = True
        use[1:] &= ~touch | (level[1:] > level[:-1])
        use[:-1] &= ~touch | (level[:-1] > level[1:])
        chosen = np.flatnonzero(use)
        enough = np.bincount(of[chosen], minlength=len(pairs)) >= LEAST
        chosen = chosen[enough[of[chosen]]]
        left = at[chosen]
        right = after[left]
        end = after[right]
        seq[left] = (base + count + np.cumsum(enough) - 1)[of[chosen]]
        alive[right] = False
        after[left] = end
        inner = end < n
        before[end[inner]] = left[inner]
        rules.append(pairs[enough])
        count += len(rules[-1])
        mark = np.zeros(n + 1, bool)  # the last is that of place -1
        mark[at[keep]] = True
        mark[before[left]] = True
        mark[right] = False
        mark[left] = inner
        at = np.flatnonzero(mark[:n])
    pairs = np.concatenate(rules)
    return seq[alive], np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def batches_of(rules: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Ranges of rules whose pairs hold no symbol of the same range; there are no more than rounds."""
    deepest = np.maximum.accumulate(np.where(rules >= base, rules.astype(np.int64) - base, -1).max(1, initial=-1))
    out, begin = [], 0
    while begin < len(rules):
        out.append((begin, begin := int(np.searchsorted(deepest, begin))))
    return out


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.int64)
    for begin, end in batches_of(rules, base):
        lengths[begin:end] = sizes(rules[begin:end], lengths, base).sum(1)
    return lengths


def sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each symbol stands for."""
    out = np.ones(symbols.shape, np.int64)
    high = symbols >= base
    out[high] = lengths[symbols[high] - base]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; only rules that they need are expanded, once each."""
    batches, need = batches_of(rules, base), np.zeros(len(rules), bool)
    need[symbols[symbols >= base] - base] = True
    for begin, end in reversed(batches):
        below = rules[begin:end][need[begin:end]]
        need[below[below >= base] - base] = True
    begins = np.concatenate([[0], np.cumsum(lengths * need)])
    flat = np.zeros(begins[-1], np.uint32)

    def told(some):
        high, size = some >= base, sizes(some, lengths, base)
        out = np.repeat(some, size).astype(np.uint32)
        if high.any():
            many = size[high]
            deep = np.repeat(high, size)
            shift = np.repeat(begins[some[high] - base] - (np.cumsum(many) - many), many)
            out[deep] = flat[np.arange(len(shift)) + shift]
        return out

    for begin, end in batches:
        flat[begins[begin]:begins[end]] = told(rules[begin:end][need[begin:end]].ravel())
    return told(symbols)


def read_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of one shard, by its position index: only the symbols that cover them are expanded."""
    base, rules = shard["base"], np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    lengths = np.frombuffer(shard["lengths"], "<u4").astype(np.int64)
    index, symbols = np.frombuffer(shard["index"], "<u8").astype(np.int64), np.frombuffer(shard["symbols"], "<u4")
    if stop <= start or not len(symbols):
        return np.zeros(0, np.uint32)
    lo, hi = int(np.searchsorted(index, start, "right")) - 1, int(np.searchsorted(index, stop, "left"))
    ids = expand(symbols[lo * INDEX_STEP:hi * INDEX_STEP], rules, lengths, base)
    return ids[start - index[lo]:stop - index[lo]]


SHARD = "part int, seq int, base int, doc_ids array<{0}>, ends binary, n_ids bigint, rules binary, lengths binary, index binary, symbols binary"


def groups(batches):
    """(ids, texts) of the rows of a task, in groups of bounded size; a null text is empty."""
    names, texts, n = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            names.append(name)
            texts.append(text.as_py() or "")
            n += len(texts[-1])
            if n >= GROUP_CHARS:
                yield names, texts
                names, texts, n = [], [], 0
    if names:
        yield names, texts


def shard_rows(path: str, end_id: int, kind: pa.DataType):
    """Shards of the (id, text) rows of a task, in their order."""

    def run(batches):
        from pyspark import TaskContext

        tokenizer, part = encoder(path), TaskContext.get().partitionId()
        base, seq = max(tokenizer.tokenizer.get_vocab_size(), end_id + 1), 0
        ids, ends, names, end = [], [0], [], np.array([end_id], "<u4")

        def shard():
            nonlocal ids, ends, names, seq
            symbols, rules = repair(np.concatenate(ids), base)
            lengths = expansion_lengths(rules, base)
            size = sizes(symbols, lengths, base)
            index = (np.cumsum(size) - size)[::INDEX_STEP]
            blobs = [np.array(ends[1:], "<u8").tobytes(), ends[-1], rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), index.astype("<u8").tobytes(), symbols.astype("<u4").tobytes()]
            types = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int32()), pa.array([names], pa.list_(kind)), *(pa.array([b], t) for b, t in zip(blobs, types, strict=True))],
                                             names=["part", "seq", "base", "doc_ids", "ends", "n_ids", "rules", "lengths", "index", "symbols"])
            ids, ends, names, seq = [], [0], [], seq + 1
            return row

        for some in groups(batches):
            for name, one in zip(some[0], tokenizer.encode(some[1]), strict=True):
                ids += [one, end]
                ends.append(ends[-1] + len(one) + 1)
                names.append(name)
                if ends[-1] >= SHARD_IDS:
                    yield shard()
        if names:
            yield shard()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> str:
    """Encode docs and write them as shards under path (by default a new folder in the shared one); the path is returned.

    Every row becomes the ids of its whole text and `end_id`; null and empty texts become the end alone.
    Rows go in ascending id order, null ids first, equal ids by the hash of their text, so repeated rows
    stand side by side. Ranges of ids and hashes make the tasks, so no order is made in one task, even if
    all ids are null. Any file of the tokenizers library will do. An empty table gives no shard.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"))
    rows = rows.repartitionByRange(partitions(spark), "id", "k").sortWithinPartitions("id", "k", "text").select("id", "text")
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    rows.mapInArrow(tidy(shard_rows(tokenizer_path, end_id, to_arrow_type(kind))), SHARD.format(kind.simpleString())).write.parquet(path)
    return path


def read_shards(batches):
    """(part, seq, doc_id, start, n_tokens, ids_crc32) for each document of a shard; start counts from the shard's first id."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), row["base"])
            ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                                              pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32; start counts all ids before it.

    Sizes of shards are summed within their task's range and over ranges, one row a range.
    """
    schema = spark.read.parquet(path).schema if not _empty(spark, path) else None
    if schema is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    shards = spark.read.schema(schema).parquet(path)
    kind = schema["doc_ids"].dataType.elementType.simpleString()
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    bases = bases.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    docs = shards.drop("n_ids", "index").mapInArrow(tidy(read_shards), f"part int, seq int, doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _empty(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(path).isEmpty()
    except Exception as e:  # Spark finds no schema where no file was written
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return True
