"""Periodic runs of words: Baier's grouping gives Lyndon arrays under both orders, their roots extend to runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, tidy

#: Words that are looked at together, or one longer document.
GROUP = 200_000


def lyndon_array(text: list[int]) -> np.ndarray:
    """Lengths of the longest Lyndon words that begin at each position; an end of the text is below every symbol.

    This is the first phase of Baier's suffix sorter. Positions are grouped by the word that each is known
    to begin with, at first its one symbol, and groups are taken from the largest down. A position that
    precedes l members of the group taken, with only larger groups between, appends the group's word l
    times to its own; those of one group with the same l form a new group right above their old one.
    A group's word is final when the group is taken, and it is the Lyndon word looked for.
    """
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    # groups form a chain from the largest down; members that moved on are told by `of`
    members = [first[c] for c in sorted(first, reverse=True)]
    length = [1] * len(members)
    below = [*range(1, len(members)), -1]
    above = list(range(-1, len(members) - 1))
    of = [0] * n
    for g, m in enumerate(members):
        for i in m:
            of[i] = g
    taken = bytearray(n + 1)  # the last byte stands for the place before the text and stays 0
    before = [-1] * n
    out = [1] * n
    g = 0 if members else -1
    while g >= 0:
        own = [i for i in members[g] if of[i] == g]
        members[g] = own
        word = length[g]
        for i in own:
            taken[i] = 1
            out[i] = word
        moved: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in own:  # ascending, so what precedes them ascends too
            j = i - 1
            while taken[j]:
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
                continue
            if last >= 0:
                moved.setdefault((of[last], times), []).append(last)
            last, times = j, 1
        if last >= 0:
            moved.setdefault((of[last], times), []).append(last)
        for old, times in sorted(moved, reverse=True) if len(moved) > 1 else moved:  # of a group, the most times first
            some = moved[old, times]
            new = len(members)
            members.append(some)
            length.append(length[old] + times * word)
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            below[up] = new  # up is the group taken or one below it
            for i in some:
                of[i] = new
        g = below[g]
    return np.array(out, np.int64)


def _equal_ahead(w: np.ndarray, a: int, b: int) -> int:
    """How many symbols from a on equal those from b on, a < b."""
    total, step = 0, 64
    while b + total < len(w):
        size = min(step, len(w) - b - total)
        differ = w[a + total:a + total + size] != w[b + total:b + total + size]
        at = int(differ.argmax())
        if differ[at]:
            return total + at
        total, step = total + size, step * 4
    return total


def runs_of(w: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols and `exponent` periods, 3 at least, by start and period.

    A run's Lyndon root, under the order that makes the symbol after the run smaller than the one a period
    before it, is the longest Lyndon word at each of its places, so at two places a period apart. Those
    places are extended to both sides by comparing symbols.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    n, found = len(w), set()
    back = w[::-1]
    for order in (w, -w):
        p = lyndon_array(order.tolist())
        i = np.arange(n)
        some = i + 2 * p <= n
        i, q = i[some], p[some]
        some = (p[i + q] == q) & (w[i] == w[i + q]) & (w[i + q - 1] == w[i + 2 * q - 1])
        i, q = i[some], q[some]
        upto: dict[int, int] = {}  # of each period, where the last run ends
        for a, period in zip(i.tolist(), q.tolist(), strict=True):
            if a + 2 * period <= upto.get(period, 0):
                continue
            end = a + period + _equal_ahead(w, a, a + period)
            begin = a - _equal_ahead(back, n - a - period, n - a)
            if end - begin >= 2 * period:
                upto[period] = end
                if end - begin >= max(least, exponent * period):
                    found.add((begin, end - begin, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def gram_size(least: int, exponent: int) -> int:
    """So many words in a row occur again a period away wherever they lie in a run: max(least, exponent * q) words hold 2 * q - 1 + this many."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))


def repeated_stretches(hashes: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a stretch of `gram` words that occurs twice or more in their document; doc ascends."""
    n = len(hashes) - gram + 1
    covered = np.zeros(len(hashes), bool)
    if n <= 0:
        return covered
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = mix64(key + hashes[k:k + n])
    key = mix64(key ^ mix64(doc[:n].astype(np.uint64)))
    at = np.flatnonzero(doc[:n] == doc[gram - 1:])
    # a table of bits leaves few that have no partner; the rest is sorted
    size = 1 << max(10, (2 * len(at)).bit_length())
    slot = (key[at] & np.uint64(size - 1)).astype(np.int64)
    at = at[np.bincount(slot, minlength=size)[slot] > 1]
    order = np.argsort(key[at], kind="stable")
    same = np.diff(key[at][order]) == 0
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for k in range(gram):
        covered[at[twice] + k] = True
    return covered


def document_runs(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = [len(t) for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = [w for t in texts for w in t]
    doc = np.repeat(np.arange(len(texts)), sizes)
    covered = repeated_stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), doc, gram_size(least, exponent))
    at = np.flatnonzero(covered)
    if len(at) < least:
        return found
    # stretches, each with a symbol of its own between it and the next, so that no run leaves one
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
    names: dict[bytes, int] = {}
    symbols = np.fromiter((names.setdefault(words[i], len(names) + 1) for i in at.tolist()), np.int64, len(at))
    symbols = np.insert(symbols, cut, len(names) + 1 + np.arange(len(cut)))
    place = np.insert(at, cut, -1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for begin, length, period in runs_of(symbols, least, exponent):
        k = int(place[begin])
        d = int(doc[k])
        found[d].append((k - int(first[d]), length, period))
    return found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for begin, length, period in runs:
        drop[begin + period] += 1
        drop[begin + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_rows(least: int, exponent: int):
    """(id, n_words, runs, collapsed) of (id, text)."""

    def work(ids, texts):
        found = document_runs(texts, least, exponent)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
        text = [b" ".join(kept_words(t, r)).decode() for t, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(text, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode().split()  # the six ASCII white-space characters
                if texts and size + len(words) > GROUP:
                    yield work(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                texts.append(words)
                size += len(words)
        if texts:
            yield work(ids, texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row a row of docs: id, n_words, runs array<struct<start, length, period>>, collapsed.

    Words are what the six ASCII white-space characters part. A run is a maximal stretch of words with
    smallest period q that has `least` words and `exponent` times q words or more (exponent 3 or more);
    runs come by start, then period. collapsed is the text of the words that no run holds after its first q
    words, joined by single blanks. Words are compared as they are, so results are exact.
    Words that lie in no repeated stretch of gram_size() words (five by default) are in no run and aren't sorted.
    Null, empty and white texts have no words, no runs and an empty collapsed text. Repeated rows and null
    ids give a row each; empty tables give no rows; extra columns are ignored. A document is worked on in
    one task, in memory of about 150 bytes a word.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run_rows(least, exponent)), f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
