"""External induced sorting of all suffixes of a shard, with common-prefix lengths.

The classic two passes: suffixes are L (larger than their right neighbour) or S; the sorted
leftmost S suffixes (LMS) induce all L suffixes in ascending order, those induce all S suffixes
in descending order. Both passes run on a monotone priority queue keyed by the first character:
a popped suffix pushes its left neighbour, whose character is not before the current one. Every
queue entry carries the suffix and the length of its common prefix with the entry before it in
its bucket: one more than the smallest length met between the two entries that induced them.

The queue and all arrays longer than ``memory`` live in files of a temporary folder of the task,
so a shard may be far larger than memory; a lost task starts its shard anew. LMS suffixes are
ordered by naming their substrings and recursing on the names; a reduced string of at most
``memory`` names is ordered directly by doubling.

Texts are integers from 1; 0 separates them. Lengths are counted up to ``cap``.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import defaultdict

import numpy as np

MEMORY = 8_000_000


class DiskQueue:
    """Append-only buckets of (suffix, length) pairs; above a size the buffers go to a file."""

    def __init__(self, folder: str, memory: int) -> None:
        self.path = os.path.join(folder, f"queue-{os.urandom(6).hex()}")
        self.memory, self.held = memory, 0
        self.parts: dict[int, list] = defaultdict(list)
        self.file = None

    def push(self, keys: np.ndarray, suffix: np.ndarray, length: np.ndarray) -> None:
        """Append entries in their order; equal keys stay in order."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, suffix, length = keys[order], suffix[order], length[order]
        cut = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(keys)), strict=True):
            self.parts[int(keys[lo])].append((suffix[lo:hi], length[lo:hi]))
        self.held += len(keys)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, p in enumerate(parts):
                if isinstance(p, tuple):
                    at = self.file.tell()
                    self.file.write(p[0].astype(np.int64).tobytes())
                    self.file.write(p[1].astype(np.int32).tobytes())
                    parts[i] = [at, len(p[0])]
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a bucket so far, in order; the bucket is empty after that."""
        out = []
        for p in self.parts.pop(key, []):
            if isinstance(p, list):
                self.file.seek(p[0])
                raw = self.file.read(12 * p[1])
                out.append((np.frombuffer(raw, np.int64, p[1]), np.frombuffer(raw, np.int32, p[1], 8 * p[1])))
            else:
                self.held -= len(p[0])
                out.append(p)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])

    def keys(self) -> list[int]:
        return list(self.parts)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


class _Minima:
    """Minimum over any range of an array: tables of doubling spans."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        span = 1
        while 2 * span <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-span], last[span:]))
            span *= 2
        self.width = len(values)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi] for each pair, lo < hi."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


class _Scan:
    """The smallest common prefix met since the last push to each bucket."""

    def __init__(self, cap: int) -> None:
        self.cap, self.since = cap, {}

    def pushes(self, target: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lengths of entries induced from places ``at`` of a batch; ``lengths[i]`` links entry i to its predecessor."""
        least = int(lengths.min()) if len(lengths) else self.cap
        if not len(at):
            for t in self.since:
                self.since[t] = min(self.since[t], least)
            return np.zeros(0, np.int32)
        table = _Minima(lengths)
        order = np.argsort(target, kind="stable")
        t, p = target[order], at[order]
        first = np.concatenate([[True], t[1:] != t[:-1]])
        lo = np.where(first, 0, np.concatenate([[0], p[:-1] + 1]))
        value = table.of(lo, p + 1)
        heads = np.flatnonzero(first)
        value[heads] = np.minimum(value[heads], np.array([self.since.get(int(x), -1) for x in t[heads]], value.dtype))
        out = np.empty(len(at), np.int32)
        out[order] = np.minimum(value + 1, self.cap)
        tails = np.append(heads[1:], len(t)) - 1
        for key in self.since:
            self.since[key] = min(self.since[key], least)
        for x, last in zip(t[tails].tolist(), p[tails].tolist(), strict=True):
            self.since[x] = int(lengths[last + 1 :].min()) if last + 1 < len(lengths) else self.cap
        return out


def _array(n: int, dtype, folder: str, memory: int) -> np.ndarray:
    if n <= memory:
        return np.zeros(n, dtype)
    return np.memmap(os.path.join(folder, f"array-{os.urandom(6).hex()}"), dtype, "w+", shape=(n,))


def types_of(text: np.ndarray, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """S flags, and each place's run length of equal characters (up to 2**31)."""
    n = len(text)
    small, run = _array(n, bool, folder, memory), _array(n, np.int32, folder, memory)
    carry_s, carry_run, nxt = False, 0, -1  # the empty suffix after the end is smaller than all
    step = max(1, min(memory, 1 << 22))
    for hi in range(n, 0, -step):
        lo = max(0, hi - step)
        part = text[lo:hi].astype(np.int64)
        after = np.append(part[1:], nxt)
        change = np.flatnonzero(part != after)
        # the place at or after each one where the character changes
        where = np.full(len(part), len(part))
        where[change] = change
        where = np.minimum.accumulate(where[::-1])[::-1]
        inside = where < len(part)
        up = part < after
        s = np.where(inside, up[np.minimum(where, len(part) - 1)], carry_s)
        r = np.where(inside, where - np.arange(len(part)) + 1, len(part) - np.arange(len(part)) + carry_run)
        small[lo:hi], run[lo:hi] = s, r
        carry_s, carry_run, nxt = bool(s[0]), int(r[0]), int(part[0])
    return small, run


def _names(text: np.ndarray, lms: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings ``text[lms : end + 1]``; equal substrings share one.

    Four characters at a time: ties go on to the next four until their substrings end.
    """
    rank = np.zeros(len(lms), np.int64)
    size, n = end - lms + 1, len(text)
    active, step = np.arange(len(lms)), 0
    while len(active):
        key = rank[active].copy()
        columns = []
        for k in range(4):
            at = lms[active] + step + k
            there = (step + k < size[active]) & (at < n)
            # an ended substring goes after longer ones with it as prefix: its last character is S, theirs L or S
            columns.append(np.where(there, text[np.minimum(at, n - 1)].astype(np.int64) + 1, np.where(step + k < size[active], 0, 1 << 40)))
        order = np.lexsort([*columns[::-1], key])
        same = np.ones(len(active), bool)
        if len(active) > 1:
            for c in [key, *columns]:
                same[1:] &= c[order][1:] == c[order][:-1]
        same[0] = False
        # ranks inside a tie spread behind the rank of the tie: ranks are positions
        base = key[order]
        head = np.concatenate([[True], base[1:] != base[:-1]])
        start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        group = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
        rank[active[order]] = base + group - start
        step += 4
        sizes = np.bincount(np.cumsum(~same) - 1)
        tied = sizes[np.cumsum(~same) - 1] > 1
        keep = np.zeros(len(active), bool)
        keep[order] = tied
        active = active[keep & (size[active] > step)]
    return np.unique(rank, return_inverse=True)[1]


def _order_names(names: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """Order of all suffixes of a string of names."""
    n = len(names)
    if n and int(names.max()) == n - 1:
        order = np.empty(n, np.int64)
        order[names] = np.arange(n)
        return order
    if n > memory:
        return suffix_order(names + 1, folder, memory)
    rank, span = names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] + 1 if span < n else 0
        key = rank * (n + 1) + second
        uniq, rank = np.unique(key, return_inverse=True)
        if len(uniq) == n:
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order
        span *= 2


def _sorted_lms(text: np.ndarray, small: np.ndarray, folder: str, memory: int) -> np.ndarray:
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return lms
    end = np.append(lms[1:], len(text))
    return lms[_order_names(_names(text, lms, end), folder, memory)]


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffix pairs, up to ``cap``: seven characters at a time, then one at a time."""
    out, active, n = np.zeros(len(a), np.int32), np.arange(len(a)), len(text)
    if len(text) and int(text.max()) < 512 and n * 8 <= 1 << 28:
        wide = text.astype(np.uint64)
        block = np.zeros(n, np.uint64)
        for k in range(min(7, n)):  # seven characters of nine bits are one exact number
            block[: n - k] |= wide[k:] << np.uint64(9 * k)
        for k in range(0, cap, 7):
            x, y = a[active] + k, b[active] + k
            ok = np.maximum(x, y) + 7 <= n
            ok[ok] = block[x[ok]] == block[y[ok]]
            active = active[ok]
            if not len(active):
                break
            out[active] = k + 7
        active = np.flatnonzero(out < cap)
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        ok = (x < n) & (y < n) & (out[active] < cap)
        ok[ok] = text[x[ok]] == text[y[ok]]
        active = active[ok]
        out[active] += 1
    return np.minimum(out, cap)


def _passes(text: np.ndarray, cap: int, folder: str, memory: int):
    """Yields (suffixes ascending, lengths) of each first character in descending order of characters."""
    n = len(text)
    small, run = types_of(text, folder, memory)
    stars = _sorted_lms(text, small, folder, memory)
    star_length = np.zeros(len(stars), np.int32)
    if cap and len(stars) > 1:
        star_length[1:] = _common_prefix(text, stars[1:], stars[:-1], cap)
    first = text[stars] if len(stars) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)
    star_of = {int(first[s]): (s, e) for s, e in zip(starts, np.append(starts[1:], len(first)), strict=True)} if len(first) else {}
    waiting, done, scan = DiskQueue(folder, memory), DiskQueue(folder, memory), _Scan(cap)

    def induce(queue: DiskQueue, source: np.ndarray, lengths: np.ndarray, small_wanted: bool) -> None:
        left = source - 1
        at = np.flatnonzero(left >= 0)
        at = at[small[left[at]] == small_wanted]
        target = text[left[at]].astype(np.int64)
        queue.push(target, left[at], scan.pushes(target, at, lengths))

    def seam(a: int, b: int) -> int:
        return min(int(run[a]), int(run[b]), cap)

    # ascending: the empty suffix induces the last place, then every bucket its L part and its stars
    if n:
        waiting.push(np.array([int(text[-1])]), np.array([n - 1]), np.zeros(1, np.int32))
        scan.since[int(text[-1])] = 0
    todo = sorted({*map(int, np.unique(text))})
    for c in todo:
        tail = None
        while True:
            got, lengths = waiting.pop(c)
            if not len(got):
                break
            lengths = np.array(lengths)
            if tail is None:
                lengths[0] = 0
            done.push(np.full(len(got), c), got, lengths)
            induce(waiting, got, lengths, False)
            tail = int(got[-1])
        if c in star_of:
            s, e = star_of[c]
            lengths = star_length[s:e].copy()
            lengths[0] = 0 if tail is None else seam(tail, int(stars[s]))
            induce(waiting, stars[s:e], lengths, False)
    waiting.close()
    # descending: every bucket its S part, largest first, then its L part backwards
    waiting, scan = DiskQueue(folder, memory), _Scan(cap)
    for c in reversed(todo):
        parts, links, head = [], [], None
        while True:
            got, lengths = waiting.pop(c)
            if not len(got):
                break
            lengths = np.array(lengths)
            if head is None:
                lengths[0] = 0
            parts.append(got)
            links.append(lengths)
            induce(waiting, got, lengths, True)
            head = int(got[-1])
        large, large_length = done.pop(c)
        if len(large):
            lengths = np.empty(len(large), np.int32)
            lengths[0] = 0 if head is None else seam(head, int(large[-1]))
            lengths[1:] = large_length[:0:-1]
            induce(waiting, large[::-1], lengths, True)
        s_part = np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int64)
        s_link = np.concatenate(links)[::-1] if links else np.zeros(0, np.int32)
        whole = np.concatenate([large, s_part])
        length = np.zeros(len(whole), np.int32)
        length[: len(large)] = large_length
        if len(s_part):
            length[len(large)] = seam(int(large[-1]), int(s_part[0])) if len(large) else 0
            length[len(large) + 1 :] = s_link[:-1]
        yield whole, length
    waiting.close()
    done.close()


def suffix_order(text: np.ndarray, folder: str, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in ascending order."""
    parts = [x for x, _ in _passes(text, 0, folder, memory)]
    return np.concatenate(parts[::-1]) if parts else np.zeros(0, np.int64)


def suffixes_with_prefixes(text: np.ndarray, cap: int, memory: int = MEMORY):
    """(suffixes ascending, common prefixes with the one before, up to cap) per first character, descending."""
    folder = tempfile.mkdtemp(prefix="suffixes-")
    try:
        yield from _passes(text, cap, folder, memory)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def repeated_places(text: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """Flags of places whose next ``length`` characters, without a separator, also start at another place."""
    flags = np.zeros(len(text), bool)
    for order, common in suffixes_with_prefixes(text, length, memory):
        hit = common >= length
        flags[order[hit]] = True
        flags[order[np.flatnonzero(hit) - 1]] = True
    zeros = np.append(np.flatnonzero(text == 0), len(text))
    hits = np.flatnonzero(flags)
    flags[hits[zeros[np.searchsorted(zeros, hits)] - hits < length]] = False
    return flags
