"""External induced suffix sorting with common-prefix values.

``SuffixSorter`` sorts the suffixes of a text that lies in a file. Suffixes are of type S if smaller than
their successor and else L; the S suffixes right of an L suffix are the seeds. The seeds' order comes from
naming the substrings between seeds and sorting the names' string by doubling; all others follow by
induction: a scan in ascending order passes each suffix's left neighbour, if it is L, on to the end of the
queue of its first symbol, a scan in descending order does the same for S. The queues are the priority
queue: its order is (symbol, arrival), so each symbol's entries are first in, first out. Entries are tuples
(position, common prefix with the entry before).

Memory doesn't grow with the text: queues keep a bounded number of entries and the rest in one file; types,
seeds, names and ranks are worked on in blocks and lie in files if longer than HELD bytes (see ``array``);
strings of more than BASE names are doubled by an external merge sort. What grows is a buffer of 16 KB for
each sorted run of MEMORY entries, and a few words for each symbol and spill of the queues.

Common-prefix values, cut off at a limit, travel with the entries: two neighbours that are induced from
entries x and y share one symbol more than the least value between x and y, which is kept up for every
symbol while the scan moves on. Only the seams inside a bucket, two for each symbol, and the seeds are
compared directly.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Strings of names up to this length are sorted by doubling in memory.
BASE = 4 << 20
#: Entries that all queues of a sorter keep in memory.
MEMORY = 1 << 20
BLOCK = 1 << 18
#: Arrays of more bytes lie in files.
HELD = 16 << 20


def array(folder: str | None, dtype: type, n: int) -> np.ndarray:
    """n zeros, in memory if few, else in a file that goes with the array."""
    size = n * np.dtype(dtype).itemsize
    if size <= HELD:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(size)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))


def blocks_of(n: int, first: int = 0) -> Iterator[slice]:
    return (slice(lo, min(n, lo + BLOCK)) for lo in range(first, n, BLOCK))


def merged(pairs: Iterator[tuple[np.ndarray, np.ndarray]], folder: str | None, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Blocks of (key, value) in the order of keys: sorted runs in a file, merged by blocks."""
    with tempfile.TemporaryFile(dir=folder) as f:
        runs: list[list[int]] = []
        parts: list[np.ndarray] = []
        end = 0

        def flush() -> None:
            nonlocal end
            run = _join(parts)
            f.write(run[np.argsort(run[:, 0], kind="stable")].tobytes())
            runs.append([end, end + len(run)])
            end += len(run)
            parts.clear()

        for key, value in pairs:
            parts.append(np.stack((key, value), 1))
            if sum(map(len, parts)) >= memory:
                flush()
        if parts:
            flush()
        size = max(1024, memory // max(1, len(runs)))

        def load(run: list[int]) -> np.ndarray:
            lo, run[0] = run[0], min(run[1], run[0] + size)
            f.seek(lo * 16)
            return np.frombuffer(f.read((run[0] - lo) * 16), np.int64).reshape(-1, 2)

        held = [(load(r), r) for r in runs]
        while held:
            top = min(int(b[-1, 0]) for b, _ in held)  # what is still in the file is not less
            out, rest = [], []
            for b, r in held:
                k = int(np.searchsorted(b[:, 0], top, "right"))
                out.append(b[:k])
                if k < len(b):
                    rest.append((b[k:], r))
                elif r[0] < r[1]:
                    rest.append((load(r), r))
            held = rest
            block = _join(out)
            yield block[np.argsort(block[:, 0], kind="stable")]


class Queues:
    """First-in first-out queues of (position, common prefix) by symbol, spilled to one file."""

    def __init__(self, folder: str, memory: int, kind: type = np.int64):
        self.file, self.kind, self.size = tempfile.TemporaryFile(dir=folder), kind, 2 * np.dtype(kind).itemsize
        self.memory, self.held, self.end = memory, 0, 0
        self.parts: dict[int, list] = {}

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        both = np.empty((len(pos), 2), self.kind)
        both[:, 0], both[:, 1] = pos, lcp
        self.parts.setdefault(symbol, []).append(both)
        self.held += len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(self.end)
        for symbol, parts in self.parts.items():
            arrays = [p for p in parts if isinstance(p, np.ndarray)]
            if arrays:
                block = np.concatenate(arrays)  # arrays are always the youngest of a queue
                self.file.write(block.tobytes())
                self.parts[symbol] = [p for p in parts if not isinstance(p, np.ndarray)] + [(self.end, len(block))]
                self.end += block.nbytes
        self.held = 0

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of the queue in order; what arrives meanwhile comes too."""
        while parts := self.parts.get(symbol):
            if isinstance(parts[0], np.ndarray):
                self.parts[symbol] = []
                block = _join(parts)
                self.held -= len(block)
                yield from (block[lo : lo + BLOCK] for lo in range(0, len(block), BLOCK))
            else:
                yield from self._load(*parts.pop(0))

    def back(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks from the end of the queue, each in order of arrival."""
        parts = self.parts.pop(symbol, [])
        if arrays := [p for p in parts if isinstance(p, np.ndarray)]:
            block = _join(arrays)
            self.held -= len(block)
            yield from (block[max(0, hi - BLOCK) : hi] for hi in range(len(block), 0, -BLOCK))
        for part in reversed(parts):
            if not isinstance(part, np.ndarray):
                at, n = part
                for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
                    yield from self._load(at + lo * self.size, min(BLOCK, n - lo))

    def _load(self, at: int, n: int) -> Iterator[np.ndarray]:
        for lo in range(0, n, BLOCK):
            self.file.seek(at + lo * self.size)
            k = min(BLOCK, n - lo)
            yield np.frombuffer(self.file.read(k * self.size), self.kind).reshape(k, 2)

    def close(self) -> None:
        self.file.close()


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def types_of(t: np.ndarray, folder: str | None = None) -> np.ndarray:
    """True for S suffixes; the end of the text is smaller than all symbols."""
    n = len(t)
    out = array(folder, bool, n)
    after = False  # the type of the suffix behind the block
    for hi in range(n, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        step = np.diff(t[lo : hi + 1].astype(np.int64))  # > 0: S, < 0: L, 0: as the next
        if hi == n:
            step = np.append(step, -1)
        at = np.where(step != 0, np.arange(hi - lo), hi - lo)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[lo:hi] = np.append(step, 1 if after else -1)[at] > 0
        after = bool(out[lo])
    return out


def doubling(s: np.ndarray, most: int = 0) -> np.ndarray:
    """The suffixes of a short string in order; with ``most`` by as many names at least, those alike in any order."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.full(n, -1)
        nxt[: max(0, n - k)] = rank[k:]
        key = (rank + 1) * (n + 2) + nxt + 1
        order = np.argsort(key)  # equal keys get one rank
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        k *= 2
        if n < 2 or rank[order[-1]] == n - 1 or 0 < most <= k:
            return order


def doubling_in_files(rank: np.ndarray, folder: str | None, memory: int, most: int = 0) -> np.ndarray:
    """The same of a string of names in which no number up to the greatest is left out; overwrites it."""
    n, k = len(rank), 1
    order = array(folder, np.int64, n)

    def keyed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for z in blocks_of(n):
            nxt = np.zeros(z.stop - z.start, np.int64)
            more = rank[z.start + k : z.stop + k]
            nxt[: len(more)] = more + 1
            yield (rank[z] + 1) * (n + 2) + nxt, np.arange(z.start, z.stop)

    while True:
        at, name, last = 0, -1, -1
        for block in merged(keyed(), folder, memory):  # reads all ranks before the first block comes
            key, pos = block[:, 0], block[:, 1]
            order[at : at + len(pos)] = pos
            names = name + np.cumsum(np.concatenate(([key[0] != last], key[1:] != key[:-1])))
            rank[pos] = names
            at, name, last = at + len(pos), int(names[-1]), int(key[-1])
        k *= 2
        if name == n - 1 or 0 < most <= k:
            return order


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, at most limit."""
    out = np.zeros(len(a), np.int32)
    at = np.flatnonzero((a >= 0) & (b >= 0)) if limit else np.zeros(0, np.int64)
    n, stop = len(t), np.full(len(a), limit, np.int32)
    if t.dtype == np.uint16 and n > 3 and t.flags.c_contiguous:  # four symbols at once, then those of the last four
        four = np.ndarray((n - 3,), np.uint64, t, 0, (2,))
        live, x, y = at, a[at], b[at]
        for k in range(0, limit, 4):
            ok = (x + k < n - 3) & (y + k < n - 3)
            live, x, y = live[ok], x[ok], y[ok]
            same = four[x + k] == four[y + k]
            live, x, y = live[same], x[same], y[same]
            if not len(live):
                break
            out[live] = min(k + 4, limit)
        at = at[out[at] < limit]
        stop = np.minimum(out + 4, limit)
    while len(at):
        k = out[at]
        more = (k < stop[at]) & (a[at] + k < n) & (b[at] + k < n)
        at, k = at[more], k[more]
        at = at[t[a[at] + k] == t[b[at] + k]]
        out[at] += 1
    return out


class SuffixSorter:
    """The suffixes of t (non-negative integers), in descending order, with common prefixes up to limit.

    With a limit, suffixes that share as many symbols may come in any order: a name stands for two symbols at least,
    so seeds are told apart by limit names, and what they induce is in order as far as that reaches.
    """

    def __init__(self, t: np.ndarray, limit: int = 0, folder: str | None = None, base: int = BASE, memory: int = MEMORY):
        self.t, self.limit, self.folder, self.base, self.memory = t, limit, folder, base, memory
        self.kind = np.int32 if len(t) < 1 << 31 else np.int64  # of places
        self.s = types_of(t, folder)
        alphabet = np.zeros(0, t.dtype)
        for z in blocks_of(len(t)):
            alphabet = np.union1d(alphabet, t[z])
        self.alphabet, self.symbols = alphabet, alphabet.tolist()
        self.spot = {c: i for i, c in enumerate(self.symbols)}
        self.spots = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) and alphabet[-1] < 1 << 16 else 0, np.uint16)
        self.spots[alphabet[: len(alphabet) if len(self.spots) else 0]] = np.arange(len(alphabet) if len(self.spots) else 0)
        count = np.zeros(len(alphabet), np.int64)
        for seeds in self._found():
            count += np.bincount(self._spots(t[seeds]), minlength=len(alphabet))
        self.bounds = np.concatenate(([0], np.cumsum(count)))  # of the seeds of each symbol
        self.seeds = array(folder, self.kind, int(self.bounds[-1]))
        at = 0
        for seeds in self._found():
            self.seeds[at : at + len(seeds)] = seeds
            at += len(seeds)

    def _spots(self, c: np.ndarray) -> np.ndarray:
        """The symbols' indexes in the alphabet."""
        return self.spots[c] if len(self.spots) else np.searchsorted(self.alphabet, c)

    def _found(self) -> Iterator[np.ndarray]:
        """The seeds in ascending order of place."""
        for z in blocks_of(len(self.t), 1):
            yield np.flatnonzero(self.s[z] & ~self.s[z.start - 1 : z.stop - 1]) + z.start

    # --- induction -----------------------------------------------------------------------------

    def _pass_on(self, block: np.ndarray, queues: Queues, least: np.ndarray, want: bool) -> None:
        """Give the left neighbours of the wanted type to their queues."""
        pos, lcp = block[:, 0], block[:, 1]
        left = np.maximum(pos - 1, 0)
        at = np.flatnonzero((pos > 0) & (self.s[left] == want))
        low = int(lcp.min()) if self.limit else 0
        if not len(at):
            if self.limit:
                np.minimum(least, low, out=least)
            return
        c = self.t[left[at]]
        order = np.argsort(c, kind="stable")  # by digits, for two bytes
        c, at = c[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True])))
        before = least.copy() if self.limit else least
        if self.limit:
            np.minimum(least, low, out=least)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            symbol, who = int(c[i]), at[i:j]
            value = np.zeros(j - i, self.kind)
            if self.limit:
                k, last = self.spot[symbol], int(who[-1])
                value = np.minimum.reduceat(lcp[: last + 1], np.concatenate(([0], who[:-1] + 1)))
                value[0] = min(int(value[0]), int(before[k]))
                value = np.where(value < 0, 0, np.minimum(value + 1, self.limit))
                least[k] = int(lcp[last + 1 :].min()) if last + 1 < len(lcp) else self.limit
            queues.put(symbol, left[who], value)

    def _induce(self, seeds: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of (suffix, common prefix with the entry before), in descending order."""
        n, t = len(self.t), self.t
        rising, stored, falling = (Queues(self.folder, self.memory, self.kind) for _ in range(3))
        try:
            nothing = -1  # no entry of this symbol has been passed on: the first shares nothing
            least = np.full(len(self.symbols), nothing)
            first = int(t[n - 1])
            rising.put(first, np.array([n - 1]), np.zeros(1, np.int64))  # induced by the end of the text
            if self.limit:
                least[self.spot[first]] = 0
            bounds = self.bounds
            for i, c in enumerate(self.symbols):
                last = -1
                for block in rising.take(c):
                    if last < 0 and self.limit:
                        block = block.copy()
                        block[0, 1] = 0
                    last = int(block[-1, 0])
                    stored.put(c, block[:, 0], block[:, 1])
                    self._pass_on(block, rising, least, False)
                for lo in range(int(bounds[i]), int(bounds[i + 1]), BLOCK):
                    hi = min(lo + BLOCK, int(bounds[i + 1]))
                    pos = seeds[lo:hi]
                    both = np.empty((len(pos), 2), self.kind)
                    both[:, 0], both[:, 1] = pos, 0
                    if self.limit:
                        before = np.empty_like(pos)
                        before[0], before[1:] = last, pos[:-1]
                        both[:, 1] = common(t, before, pos, self.limit)
                    last = int(pos[-1])
                    self._pass_on(both, rising, least, False)
            least = np.full(len(self.symbols), nothing)
            for c in reversed(self.symbols):
                last, seam = -1, 0
                for block in falling.take(c):
                    if last < 0 and self.limit:
                        block = block.copy()
                        block[0, 1] = 0
                    last = int(block[-1, 0])
                    yield block
                    self._pass_on(block, falling, least, True)
                fresh = True
                for block in stored.back(c):
                    pos = block[::-1, 0]
                    if fresh:
                        seam = int(common(t, np.array([last]), pos[:1], self.limit)[0]) if self.limit else 0
                        fresh = False
                    out = np.empty_like(block)
                    out[:, 0], out[0, 1], out[1:, 1] = pos, seam, block[:0:-1, 1]
                    seam = int(block[0, 1])
                    yield out
                    self._pass_on(out, falling, least, True)
        finally:
            for q in (rising, stored, falling):
                q.close()

    # --- seeds ---------------------------------------------------------------------------------

    def _by_symbol(self) -> np.ndarray:
        """The seeds by their first symbol and, among equal ones, by place."""
        out, free = array(self.folder, self.kind, len(self.seeds)), self.bounds[:-1].copy()
        for z in blocks_of(len(self.seeds)):
            c = self._spots(self.t[self.seeds[z]])
            order = np.argsort(c, kind="stable")
            c, n = c[order], np.bincount(c, minlength=len(free))
            out[free[c] + np.arange(len(c)) - (np.cumsum(n) - n)[c]] = self.seeds[z][order]
            free += n
        return out

    def _sorted_seeds(self) -> np.ndarray:
        t, s, seeds = self.t, self.s, self.seeds
        m = len(seeds)
        if m < 2:
            return seeds
        plain = SuffixSorter.__new__(SuffixSorter)
        plain.__dict__ |= self.__dict__ | {"limit": 0}
        order = array(self.folder, self.kind, m)  # by the substrings up to the next seed
        end = m
        for b in plain._induce(self._by_symbol()):
            pos = b[:, 0]
            pos = pos[(pos > 0) & s[pos] & ~s[np.maximum(pos - 1, 0)]]
            order[end - len(pos) : end] = pos[::-1]
            end -= len(pos)
        string, name = array(self.folder, np.int64, m), -1
        index_of = array(self.folder, self.kind, len(t))
        for z in blocks_of(m):
            index_of[seeds[z]] = np.arange(z.start, z.stop)
        for z in blocks_of(m):
            o = order[max(0, z.start - 1) : z.stop]  # with the one before
            index = index_of[o]
            length = np.where(index < m - 1, seeds[np.minimum(index + 1, m - 1)], len(t)) - o
            same = np.zeros(len(o), bool)
            pair = np.flatnonzero((length[1:] == length[:-1]) & (index[1:] != m - 1) & (index[:-1] != m - 1)) + 1
            k = 0
            while len(pair):  # equal up to and with the next seed's first symbol
                equal = t[o[pair] + k] == t[o[pair - 1] + k]
                pair = pair[equal]
                done = length[pair] == k
                same[pair[done]] = True
                pair = pair[~done]
                k += 1
            mine = slice(int(z.start > 0), None)
            names = name + np.cumsum(~same[mine])
            string[index[mine]] = names
            name = int(names[-1])
        if name == m - 1:
            return order
        if m <= self.base:
            return seeds[doubling(string, self.limit)]
        by_rank = doubling_in_files(string, self.folder, self.memory, self.limit)
        for z in blocks_of(m):
            order[z] = seeds[by_rank[z]]
        return order

    def descending(self) -> Iterator[np.ndarray]:
        if len(self.t):
            yield from self._induce(self._sorted_seeds())


def groups(t: np.ndarray, limit: int, folder: str | None = None, **options: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffixes in descending order as (positions, whether each begins a set that shares limit symbols)."""
    for block in SuffixSorter(t, limit, folder, **options).descending():
        if len(block):
            yield block[:, 0], block[:, 1] < limit


def work_folder() -> str:
    """A folder of this task's own for queues and arrays; nothing in it outlives the task."""
    return tempfile.mkdtemp(prefix="suffixes-", dir=os.environ.get("TMPDIR") or None)
