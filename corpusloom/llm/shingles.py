"""Word shingles of Arrow texts as 64-bit hashes, by arrays alone: no Python object a word.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Its hash is a sum of random values by (place, byte);
places from 64 on use the first 64 places' values times an odd number of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
PLACES = 64

_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


with np.errstate(over="ignore"):
    _VALUES = mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _P)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin in them, with the end; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    got = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return got[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and by row the number of words before it, with the total."""
    blank = _BLANK[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    first[1:-1] = blank[:-1]
    first[begins] = True
    at = np.flatnonzero(first[:-1] & ~blank) if len(data) else np.empty(0, np.int64)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(begins), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place[: at[0]] = 0
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(data))))
    with np.errstate(over="ignore"):
        values = _VALUES[((place & (PLACES - 1)) << 8) | _LOWER[data]]
        values[blank] = 0
        far = np.flatnonzero((place >= PLACES) & ~blank)
        if len(far):
            values[far] *= mixed((place[far] // PLACES).astype(np.uint64) * _P) | np.uint64(1)
        return mixed(np.add.reduceat(values, at)), np.searchsorted(at, begins)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; of fewer words than a shingle has, one for all of them."""
    flat, ends = word_hashes(*bytes_of(column))
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
        for i in range(words):
            rolled = rolled * _P + flat[i : len(flat) - words + 1 + i]
        rolled = mixed(rolled)
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if end - begin >= words:
                s = np.sort(rolled[begin : end - words + 1])
                out.append(s if (s[1:] != s[:-1]).all() else s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif end > begin:
                one = np.uint64(end - begin)
                for h in flat[begin:end]:
                    one = one * _P + h
                out.append(mixed(np.array([one])))
            else:
                out.append(np.empty(0, np.uint64))
    return out
