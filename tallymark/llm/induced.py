"""Suffix order with common prefixes by external induced sorting, for strings that need not fit into memory.

A suffix is S-type if it is smaller than the next one, else L-type; LMS suffixes are S-type with an L-type before them.
The substrings between LMS positions are named in order, the string of names is sorted by recursion, and its order
induces all others: an L-type suffix is a tuple of its characters up to the next LMS position and that one's rank, an
S-type suffix one of its characters up to the next L-type suffix and that one's rank. Tuples go through a queue that
keeps sorted runs on disk and hands them out merged; common prefixes of neighbours are carried along: the characters
two tuples share, then the smallest common prefix between their ranks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Elements a queue holds in memory before it writes a run, and elements an array may have before it lies on disk.
MEMORY, BLOCK = 1 << 22, 1 << 18
LIMIT = 200  # common prefixes are exact below this and cut off here


class Scratch:
    """Arrays in memory or, beyond `memory` elements, in files of a folder that goes with the task."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self._folder, self._n = memory, None, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self._folder:
            self._folder.cleanup()

    def path(self) -> str:
        if self._folder is None:
            self._folder = tempfile.TemporaryDirectory(prefix="induced-")
        self._n += 1
        return os.path.join(self._folder.name, str(self._n))

    def array(self, n: int, kind: type) -> np.ndarray:
        return np.zeros(n, kind) if n <= self.memory else np.memmap(self.path(), kind, "w+", shape=(n,))


class Spool:
    """Text gathered piece by piece, in memory up to the scratch's bound and on disk beyond."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.buffer, self.file, self.n = scratch, bytearray(), None, 0

    def add(self, piece: np.ndarray) -> None:
        self.buffer += piece.tobytes()
        self.n += len(piece)
        if len(self.buffer) > self.scratch.memory:
            if self.file is None:
                self.file = open(self.scratch.path(), "w+b")  # noqa: SIM115
            self.file.write(self.buffer)
            self.buffer.clear()

    def text(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(self.buffer, np.uint8)
        self.file.write(self.buffer)
        self.file.close()
        return np.memmap(self.file.name, np.uint8, "r")


class Queue:
    """A disk-backed priority queue of (key, value): filled in any order, emptied in order of key, then of value."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.n, self.runs = scratch, [], 0, []

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.held.append((keys, values))
        self.n += len(keys)
        if self.n > self.scratch.memory:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        self.held, self.n = [], 0
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def _spill(self) -> None:
        run = []
        for part in self._sorted():
            path = self.scratch.path()
            part.tofile(path)
            run.append(np.memmap(path, part.dtype, "r"))
        self.runs.append(run)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order; equal keys never lie in different blocks."""
        if not self.runs:
            if self.n:
                yield self._sorted()
            return
        if self.n:
            self._spill()
        at = [0] * len(self.runs)
        while True:
            open_runs = [r for r, (keys, _) in enumerate(self.runs) if at[r] < len(keys)]
            if not open_runs:
                return
            bound = min(self.runs[r][0][min(at[r] + BLOCK, len(self.runs[r][0])) - 1] for r in open_runs)
            parts = []
            for r in open_runs:
                keys, values = self.runs[r]
                end = at[r] + int(np.searchsorted(keys[at[r] :], bound, side="right"))
                parts.append((np.array(keys[at[r] : end]), np.array(values[at[r] : end])))
                at[r] = end
            keys, values = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            yield keys[order], values[order]


class Prefixes:
    """Smallest of the common prefixes between two ranks, from those of neighbours."""

    def __init__(self, lcp: np.ndarray):
        self.levels = [lcp]
        span = 1
        while 2 * span <= len(lcp):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-span], below[span:]))
            span *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """low < high; lcp[k] belongs to ranks k - 1 and k."""
        width = high - low
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at] + 1], table[high[at] + 1 - (1 << int(k))])
        return out


class Level:
    """One string of the recursion: text of codes, 0 at the end only; types and what lies where."""

    def __init__(self, text: np.ndarray, scratch: Scratch):
        self.text, self.scratch, n = text, scratch, len(text)
        self.bits = 9 if text.dtype == np.uint8 else 33
        self.per = 63 // self.bits
        step = np.flatnonzero(text[1:] != text[:-1])  # last positions of runs of equal codes, the end left out
        up = text[step] < text[step + 1]
        self.small = scratch.array(n, np.bool_)  # S-type
        self.small[:] = np.append(np.repeat(up, np.diff(step, prepend=-1)), True)[:n] if len(step) else True
        self.run = scratch.array(n, np.uint8)  # equal codes from here on, up to LIMIT
        ends = np.append(np.repeat(step, np.diff(step, prepend=-1)), n - 1)[:n]
        self.run[:] = np.minimum(ends - np.arange(n) + 1, LIMIT)
        small = self.small
        self.lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        self.packed = self._pack()

    def _pack(self) -> np.ndarray:
        """`per` codes from every position on, each with its type in the low bit, first code in the high bits."""
        n, bits = len(self.text), self.bits
        packed = self.scratch.array(n, np.uint64)
        for k in range(0, n, BLOCK):
            end = min(k + BLOCK, n)
            code = np.zeros(end - k + self.per, np.uint64)
            stop = min(end + self.per, n)
            code[: stop - k] = (self.text[k:stop].astype(np.uint64) << np.uint64(1)) | self.small[k:stop]
            out = code[: end - k].copy()
            for j in range(1, self.per):
                out = (out << np.uint64(bits)) | code[j : end - k + j]
            packed[k:end] = out
        return packed

    def chunk(self, at: np.ndarray, size: np.ndarray, r: int) -> np.ndarray:
        """Codes r * per .. of tuples starting at `at` with `size` codes, types in the low bits, packed; 0 behind the last."""
        key = self.packed[np.minimum(at + r * self.per, len(self.text) - 1)]
        empty = (np.clip(self.per * (r + 1) - size, 0, self.per) * self.bits).astype(np.uint64)
        return (key >> empty) << empty

    def first_apart(self, differ: np.ndarray, r: int) -> np.ndarray:
        """Number of codes before the first that differs, in packed chunks r with exclusive-or `differ`."""
        top = np.frexp(differ.astype(np.float64))[1]  # the conversion may round up to the next power of two
        top -= differ < (np.uint64(1) << np.maximum(top - 1, 0).astype(np.uint64))
        return r * self.per + self.per - 1 - (top - 1) // self.bits

    def shared(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes whose codes or types first differ at k."""
        last = len(self.text) - 1
        pa, pb = np.minimum(a + k, last), np.minimum(b + k, last)
        same = self.text[pa] == self.text[pb]  # the same code, but of different types: a run that goes on
        return np.minimum(k + np.where(same, np.minimum(self.run[pa], self.run[pb]), 0), LIMIT).astype(np.uint8)

    def order(self, at: Iterator[np.ndarray], size_of, rank_of, prefixes: Prefixes | None, n: int, lcps: bool):
        """Sorted positions, their neighbours' common prefixes and whether each equals the one before.

        size_of(positions) is the number of codes of a tuple; rank_of(positions) the rank it ends in (or None).
        """
        queue = Queue(self.scratch)
        for some in at:
            queue.push(self.chunk(some, size_of(some), 0), some)
        sa, lcp, equal = self.scratch.array(n, np.int64), self.scratch.array(n if lcps else 0, np.uint8), self.scratch.array(n, np.bool_)
        done, before = 0, None
        for keys, found in queue.drain():
            m = len(found)
            size = size_of(found)
            chunks = -(-size // self.per)
            same = np.concatenate(([False], keys[1:] == keys[:-1]))
            common, place = np.zeros(m, np.uint8), np.full(m, -1, np.int64)
            if lcps:
                differ = keys ^ np.concatenate(([keys[0] if before is None else before[0]], keys[:-1]))
                rows = np.flatnonzero(differ)
                place[rows] = self.first_apart(differ[rows], 0)
            r = 1
            follows = np.append(same, False)  # whether a row equals the one before, so far; one more behind the last
            rows = np.flatnonzero(follows[:-1] | follows[1:])
            while True:
                # members of groups still tied, each group by its next chunk or, behind the last, by its rank
                rows = rows[r <= chunks[rows] - (rank_of is None)]
                if not len(rows):
                    break
                g = np.cumsum(~follows[rows])
                p, final = found[rows], chunks[rows] == r
                key = np.zeros(len(rows), np.uint64)
                if (~final).any():
                    key[~final] = self.chunk(p[~final], size[rows][~final], r)
                if final.any():
                    key[final] = rank_of(p[final], size[rows][final])
                shuffle = np.lexsort((key, g))
                p, key, final = p[shuffle], key[shuffle], final[shuffle]
                s = size[rows][shuffle]
                found[rows], size[rows], chunks[rows] = p, s, chunks[rows][shuffle]
                inner = np.flatnonzero(g[1:] == g[:-1]) + 1
                apart = inner[key[inner] != key[inner - 1]]
                follows[rows[inner]] = key[inner] == key[inner - 1]
                if lcps and len(apart):
                    ranked = final[apart]
                    a = apart[~ranked]
                    place[rows[a]] = self.first_apart(key[a] ^ key[a - 1], r)
                    a = apart[ranked]
                    if len(a):
                        rest = prefixes.between(key[a - 1].astype(np.int64), key[a].astype(np.int64))
                        common[rows[a]] = np.minimum(s[a] - 1 + rest, LIMIT)
                rows = rows[follows[rows] | follows[rows + 1]]
                r += 1
            sa[done : done + m], equal[done : done + m] = found, follows[:-1]
            if lcps:  # runs go beyond chunks, so they are looked up where neighbours are final
                rows = np.flatnonzero(place >= 0)
                prev = np.concatenate(([found[0] if before is None else before[1]], found[:-1]))
                common[rows] = self.shared(prev[rows], found[rows], place[rows])
                lcp[done : done + m] = common
            before = (keys[-1], found[-1])
            done += m
        return sa, lcp, equal

    def pieces(self, at: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(at), BLOCK):
            yield np.asarray(at[k : k + BLOCK])

    def next_of(self, marks: np.ndarray):
        """For positions, codes up to and including the next marked position behind them."""
        after = self.scratch.array(len(self.text), np.int64)
        after[: marks[-1]] = np.repeat(marks, np.diff(marks, prepend=0))

        def size(p: np.ndarray) -> np.ndarray:
            return after[p] - p + 1

        return size

    def lms_ranks(self) -> np.ndarray:
        """Rank among LMS suffixes for each LMS position in text order: by names, or by recursion over them."""
        lms, n = self.lms, len(self.lms)
        behind = self.next_of(lms)

        def size(p: np.ndarray) -> np.ndarray:
            return np.maximum(behind(p), 1)  # the end has none behind it

        sa, _, equal = self.order(self.pieces(lms), size, None, None, n, False)
        name = self.scratch.array(n, np.int64)
        name[self.number[sa]] = np.cumsum(~equal) - 1
        if not equal.any():
            return name
        below = Level(name.astype(np.uint32), self.scratch)
        rank = self.scratch.array(n, np.int64)
        for order, base in zip(below.suffixes(False)[:2], below.bases(), strict=True):
            rank[order[0]] = np.arange(len(order[0])) + base(order[0])
        return rank

    def bases(self):
        """How far L- and S-type suffixes are moved, in the order of all suffixes, by those of the other type."""
        codes = self.text
        large, small = (np.sort(codes[self.small == t]) for t in (False, True))
        return (lambda p: np.searchsorted(small, codes[p], side="left")), (lambda p: np.searchsorted(large, codes[p], side="right"))

    def suffixes(self, lcps: bool):
        """((L-type suffixes in order, their common prefixes), (S-type suffixes in order, theirs))."""
        n = len(self.text)
        lms = self.lms
        if n == 1:
            one = np.zeros(1, np.int64), np.zeros(1, np.uint8)
            return (one[0][:0], one[1][:0]), one
        self.number = self.scratch.array(n, np.int64)  # of LMS positions
        self.number[lms] = np.arange(len(lms))
        rank = self.lms_ranks()
        prefixes = None
        if lcps:
            by_rank = np.empty(len(lms), np.int64)
            by_rank[rank] = lms
            prefixes = Prefixes(self.compared(by_rank))
        large = np.flatnonzero(~self.small)
        sizes = self.next_of(lms)
        l_sa, l_lcp, _ = self.order(
            self.pieces(large), sizes, lambda p, s: rank[self.number[p + s - 1]].astype(np.uint64), prefixes, len(large), lcps
        )
        l_rank = self.scratch.array(n, np.int64)
        l_rank[l_sa] = np.arange(len(l_sa))
        prefixes = Prefixes(l_lcp) if lcps else None
        small = np.flatnonzero(self.small[:-1])
        s_sa, s_lcp, _ = self.order(
            self.pieces(small), self.next_of(large), lambda p, s: l_rank[p + s - 1].astype(np.uint64), prefixes, len(small), lcps
        )
        end = np.array([n - 1])  # the end is the smallest S-type suffix and shares nothing
        return (l_sa, l_lcp), (np.concatenate([end, s_sa]), np.concatenate([np.zeros(1, np.uint8), s_lcp]) if lcps else s_lcp)

    def compared(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbouring suffixes, found by comparing eight codes at a time."""
        padded = np.concatenate([self.text, np.zeros(LIMIT + 16, np.uint8)])
        words = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
        out = np.zeros(len(order), np.uint8)
        for k in range(1, len(order), BLOCK):
            rows = np.arange(k, min(k + BLOCK, len(order)))
            a, b = order[rows - 1], order[rows]
            for at in range(0, LIMIT, 8):
                differ = words[a + at] ^ words[b + at]
                apart = differ != 0
                if apart.any():
                    low = differ[apart] & (~differ[apart] + np.uint64(1))  # lowest set bit: its byte is the first that differs
                    out[rows[apart]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
                    rows, a, b = rows[~apart], a[~apart], b[~apart]
                    if not len(rows):
                        break
            out[rows] = LIMIT
        return np.minimum(out, LIMIT)


def repeated(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Marks every position of `text` (codes 1.. and a single 0 at the end) whose LIMIT codes start elsewhere too."""
    level = Level(text, scratch)
    marks = scratch.array(len(text), np.bool_)
    for sa, lcp in level.suffixes(True):
        far = lcp >= LIMIT
        marks[sa[far]] = True
        marks[sa[np.append(far[1:], False)]] = True
    # L- and S-type suffixes share LIMIT codes only where all are the same code
    flat = np.flatnonzero(level.run >= LIMIT)
    codes, count = np.unique(text[flat], return_counts=True)
    marks[flat[np.isin(text[flat], codes[count > 1])]] = True
    return marks
