"""Sets of hashed word shingles, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .common import mix64, powers, prefix_sums

#: Bytes of texts that are hashed at a time; longer texts are cut between words.
CHUNK = (1 << 19) - (1 << 14)
_UPPER, _WHITE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(9, 14))
#: Lower-cases A-Z and makes the six ASCII white-space characters blanks.
PLAIN = bytes.maketrans(_UPPER + _WHITE, _UPPER.lower() + b" " * len(_WHITE))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes; no word is cut."""
    at = 0
    while len(raw) - at > CHUNK:
        end = raw.rfind(b" ", at + 1, at + CHUNK)
        if end < 0:
            end = raw.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each piece)."""
    data = np.frombuffer(b" ".join([*pieces, b""]), np.uint8)
    edge = np.diff(np.concatenate([[True], data == 32, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total, down = prefix_sums(data), powers(len(data))[1]
    length = (end - begin).astype(np.uint64)
    hashes = mix64((total[end] - total[begin]) * down[begin] + length * np.uint64(0xD6E8FEB86659FD93))
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return hashes, np.diff(np.searchsorted(begin, ends), prepend=0)


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's lower-cased words, many texts at a time."""
    group: list[bytes] = []
    size = 0

    def flush():
        hashes, counts = _hashed(group)
        return np.split(hashes, np.cumsum(counts)[:-1])

    for text in texts:
        raw = (text or "").encode().translate(PLAIN)
        if group and size + len(raw) > CHUNK:
            yield from flush()
            group, size = [], 0
        if len(raw) > CHUNK:
            yield np.concatenate([_hashed([p])[0] for p in _pieces(raw)])
        else:
            group.append(raw)
            size += len(raw)
    if group:
        yield from flush()


@lru_cache(maxsize=64)
def coefficients(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash for each window of `width` words, in order; with fewer words, one for them all; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    if n < width:
        return mix64((hashes * coefficients(n, seed + n)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    out = np.zeros(n - width + 1, np.uint64)
    for i, c in enumerate(coefficients(width, seed)):
        out += hashes[i:i + n - width + 1] * c
    return mix64(out)


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    for hashes in word_hashes(texts):
        s = np.sort(window_hashes(hashes, width))
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
