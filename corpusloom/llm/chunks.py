"""A bounded table of distinct chunks of text, filled by a library and read by arrays.

Chunks are known by two 64-bit hashes of their bytes, so that no Python object is made a chunk that
the table holds. What a chunk stands for (ids, digits, text) lies in pools of numbers, and a slice's
results are put together by position from there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from corpusloom.llm.shingles import mixed

PLACES = 64
_P = np.uint64(0x9E3779B97F4A7C15)

with np.errstate(over="ignore"):
    _VALUES = [mixed((np.arange(1, PLACES * 256 + 1, dtype=np.uint64) + np.uint64(seed)) * _P) for seed in (1 << 32, 1 << 33)]


def hashes(data: np.ndarray, at: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each chunk, which begins ``at`` and ends with the next; ``blank`` bytes don't count."""
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place[: at[0]] = 0
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(data))))
    index = ((place & (PLACES - 1)) << 8) | data
    far = np.flatnonzero(place >= PLACES)
    with np.errstate(over="ignore"):
        times = mixed((place[far] // PLACES).astype(np.uint64) * _P) | np.uint64(1)
        out = []
        for values in _VALUES:
            got = values[index]
            if len(far):
                got[far] *= times
            if blank is not None:
                got[blank] = 0
            out.append(np.add.reduceat(got, at))
    return out[0], out[1]


class ChunkTable:
    """``make`` gives each of many chunks (bytes) its arrays, one a pool; ``kinds`` are the pools' types.

    It is emptied before a slice once it has ``rows`` chunks or ``room`` bytes in its pools.
    """

    def __init__(self, make: Callable[[list[bytes]], list[tuple[np.ndarray, ...]]], kinds: list[str], rows: int = 1 << 19, room: int = 1 << 24) -> None:
        self.make, self.kinds, self.rows, self.room = make, [np.dtype(k) for k in kinds], rows, room
        self.first: tuple | None = None
        self.clear()

    def clear(self) -> None:
        if self.first is not None:
            self.h1, self.h2, self.entry, self.pools, self.ends = (list(x) if isinstance(x, list) else x for x in self.first)
            return
        self.h1, self.h2, self.entry = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.pools = [np.empty(1 << 12, k) for k in self.kinds]
        self.ends = [np.zeros(1, np.int64) for _ in self.kinds]

    def start_with(self, columns: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Whenever the table is empty it has these chunks at first; of the chunks and each pool, values on end and their sizes."""
        (data, size), *pools = columns
        if self.first is not None or not len(size):
            return
        h1, h2 = hashes(data, np.cumsum(size) - size)
        order = np.argsort(h1, kind="stable")
        # of two with one first hash the other is learned when it is met
        order = order[np.concatenate([[True], h1[order][1:] != h1[order][:-1]])]
        ends = [np.concatenate([[0], np.cumsum(n)]) for _, n in pools]
        self.first = (h1[order], h2[order], order.astype(np.int32), [np.array(values, k) for (values, _), k in zip(pools, self.kinds, strict=True)], ends)
        self.clear()

    def _found(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entries, -1 where there is none."""
        if not len(self.h1):
            return np.full(len(h1), -1, np.int32)
        i = np.searchsorted(self.h1, h1)
        i[i == len(self.h1)] = 0
        return np.where((self.h1[i] == h1) & (self.h2[i] == h2), self.entry[i], -1).astype(np.int32)

    def entries(self, data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, cut: bytes = b"") -> np.ndarray:
        """Each chunk's entry; new chunks are learned, without ``cut`` bytes at their end."""
        if len(self.entry) > self.rows or sum(e[-1] * k.itemsize for e, k in zip(self.ends, self.kinds, strict=True)) > self.room:
            self.clear()
        out = self._found(h1, h2)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        # a first hash that another chunk has already: the second one is mixed in
        taken = np.zeros(len(new), bool)
        if len(self.h1):
            taken = self.h1[np.minimum(np.searchsorted(self.h1, h1[new]), len(self.h1) - 1)] == h1[new]
        with np.errstate(over="ignore"):
            own = np.where(taken, mixed(h1[new] + h2[new]), h1[new])
        if taken.any():
            out[new] = self._found(own, h2[new])
        order = np.argsort(own, kind="stable")
        begins = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        inverse = np.empty(len(own), np.int64)
        inverse[order] = np.cumsum(begins) - 1
        firsts, seen = own[order][begins], new[order[begins]]
        odd = h2[new] != h2[seen[inverse]]
        need = np.flatnonzero(out[seen] < 0)
        to = np.append(at, len(data))
        words = [data[to[i] : to[i + 1]].tobytes().rstrip(cut) if cut else data[to[i] : to[i + 1]].tobytes() for i in seen[need].tolist()]
        made = np.full(len(firsts), -1, np.int32)
        made[need] = self._add(words)
        keys = firsts[need]
        where = np.searchsorted(self.h1, keys)
        self.h1, self.h2, self.entry = np.insert(self.h1, where, keys), np.insert(self.h2, where, h2[seen[need]]), np.insert(self.entry, where, made[need])
        got = made[inverse]
        out[new] = np.where(out[new] < 0, got, out[new])
        for i in new[odd].tolist():  # two new chunks with one first hash
            out[i] = self._add([data[to[i] : to[i + 1]].tobytes().rstrip(cut) if cut else data[to[i] : to[i + 1]].tobytes()])[0]
        return out

    def _add(self, words: list[bytes]) -> np.ndarray:
        rows = self.make(words)
        first = len(self.ends[0]) - 1
        for p, kind in enumerate(self.kinds):
            flat = np.concatenate([r[p] for r in rows]) if rows else np.empty(0, kind)
            begin = int(self.ends[p][-1])
            if begin + len(flat) > len(self.pools[p]):
                self.pools[p] = np.concatenate([self.pools[p][:begin], np.empty(begin + 2 * len(flat), kind)])
            self.pools[p][begin : begin + len(flat)] = flat
            self.ends[p] = np.concatenate([self.ends[p], begin + np.cumsum([len(r[p]) for r in rows], dtype=np.int64)])
        return np.arange(first, first + len(words), dtype=np.int32)

    def joined(self, pool: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' numbers one after the other, and where each begins, with the total."""
        begin, size = self.ends[pool][entries], self.ends[pool][entries + 1] - self.ends[pool][entries]
        ends = np.cumsum(size)
        at = np.concatenate([[0], ends])
        index = np.repeat(begin - at[:-1], size)
        index += np.arange(len(index))
        return self.pools[pool][index], at
