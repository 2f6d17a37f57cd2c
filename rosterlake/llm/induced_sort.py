"""Suffix sorting of one shard by induced sorting with disk-backed bucket queues.

Suffixes enter the queue of their first symbol in sorted order and leave it in
that order (all insertions go to buckets not yet passed), so a first-in first-out
file per symbol is the priority queue. A queue keeps a bounded number of suffix
numbers in memory and writes the rest to temporary files of the task. Whole
buckets are induced at a time with numpy.

The leftmost-S substrings are sorted by one induction, named, and the string of
names is sorted by recursion: by induction again while its alphabet is small, by
prefix doubling of names otherwise; a second induction gives all suffixes.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

QUEUE_ITEMS = 8_000_000       # suffix numbers held in memory by one queue set
MAX_ALPHABET = 4096           # larger alphabets of names are sorted by doubling


class BucketQueues:
    """Monotone priority queue: a first-in first-out queue per symbol, spilled to disk beyond ``limit``."""

    def __init__(self, folder: str, name: str, limit: int = QUEUE_ITEMS):
        self.folder, self.name, self.limit = folder, name, limit
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, str] = {}
        self.held = 0

    def push(self, symbol: int, items: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(items)
        self.held += len(items)
        if self.held > self.limit:
            for s, parts in self.parts.items():
                path = self.files.setdefault(s, os.path.join(self.folder, f"{self.name}-{s}"))
                with open(path, "ab") as f:
                    for p in parts:
                        f.write(p.astype(np.int32).tobytes())
            self.parts.clear()
            self.held = 0

    def push_sorted(self, symbols: np.ndarray, items: np.ndarray) -> None:
        """Push items to their symbols' queues, in order."""
        if len(items) == 0:
            return
        order = np.argsort(symbols, kind="stable")
        symbols, items = symbols[order], items[order]
        cut = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(items)], strict=True):
            self.push(int(symbols[a]), items[a:b])

    def pop(self, symbol: int) -> np.ndarray:
        out = []
        if (path := self.files.pop(symbol, None)) is not None:
            out.append(np.fromfile(path, dtype=np.int32))
            os.remove(path)
        parts = self.parts.pop(symbol, [])
        self.held -= sum(map(len, parts))
        out += parts
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one is larger than the (empty) next."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))             # of i and i + 1
    known = np.append(np.where(step != 0, np.arange(n - 1), n), n - 1)
    known[-1] = n - 1
    after = np.minimum.accumulate(known[::-1])[::-1]        # next place whose symbol differs from its follower
    return np.append(step > 0, False)[np.minimum(after, n - 1)]


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, folder: str) -> np.ndarray:
    """All suffixes in order, from the leftmost-S suffixes ``seeds`` in order."""
    symbols = np.unique(t).tolist()
    n = len(t)
    seed_at = {s: seeds[a:b] for s, a, b in _by_symbol(t, seeds)}
    queue = BucketQueues(folder, "l")
    queue.push(int(t[n - 1]), np.array([n - 1], dtype=np.int32))   # the last suffix is of type L
    larger: dict[int, np.ndarray] = {}
    for c in symbols:
        parts = [queue.pop(c)]
        while len(parts[-1]):                                 # runs of the same symbol
            before = parts[-1][parts[-1] > 0] - 1
            parts.append(before[(t[before] == c) & ~is_s[before]])
        bucket = larger[c] = np.concatenate(parts)
        for source in (bucket, seed_at.get(c, _NONE)):
            before = source[source > 0] - 1
            before = before[(t[before] > c) & ~is_s[before]]
            queue.push_sorted(t[before], before)
    queue = BucketQueues(folder, "s")
    out: list[np.ndarray] = []
    for c in reversed(symbols):
        parts = [queue.pop(c)]
        while len(parts[-1]):
            before = parts[-1][parts[-1] > 0] - 1
            parts.append(before[(t[before] == c) & is_s[before]])
        bucket = np.concatenate([*parts, larger[c][::-1]])    # descending
        # of an L bucket's run, the S neighbours of the same symbol don't exist
        before = bucket[bucket > 0] - 1
        before = before[(t[before] < c) & is_s[before]]
        queue.push_sorted(t[before], before)
        out.append(bucket)
    return np.concatenate(out)[::-1] if out else _NONE


_NONE = np.zeros(0, dtype=np.int32)


def _by_symbol(t: np.ndarray, order: np.ndarray):
    if len(order):
        s = t[order]
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            yield int(s[a]), a, b


def by_doubling(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, k = len(t), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1])) if n else order
        if k >= depth or n == 0 or new[-1] == n - 1:
            return order.astype(np.int32)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        k *= 2


def sort_suffixes(t: np.ndarray, depth: int, folder: str | None = None) -> np.ndarray:
    """Suffixes of ``t`` in the order of their first ``depth`` symbols at least."""
    if folder is None:
        with tempfile.TemporaryDirectory() as own:
            return sort_suffixes(t, depth, own)
    n = len(t)
    if n < 3:
        return by_doubling(t, depth)
    is_s = s_types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + np.int32(1)
    if len(lms) == 0:
        return _induce(t, is_s, lms, folder)
    # first induction: substrings between leftmost-S places come out sorted
    rough = lms[np.argsort(t[lms], kind="stable")]
    order = _induce(t, is_s, rough, folder)
    place = np.full(n, -1, dtype=np.int32)
    place[lms] = np.arange(len(lms))
    sorted_lms = order[place[order] >= 0]
    # equal neighbours share a name: compared by hash of symbols and types up to the next such place
    size = np.append(lms[1:], n - 1) - lms + 1
    h = _piece_hashes(t, is_s, lms, size)
    k = place[sorted_lms]
    same = (size[k][1:] == size[k][:-1]) & (h[k][1:] == h[k][:-1]) & (k[1:] != len(lms) - 1) & (k[:-1] != len(lms) - 1)
    names = np.empty(len(lms), dtype=np.int64)
    names[k] = np.append(0, np.cumsum(~same))
    if names.max() == len(lms) - 1:
        seeds = sorted_lms
    elif names.max() < MAX_ALPHABET and len(lms) > MAX_ALPHABET:
        with tempfile.TemporaryDirectory(dir=folder) as deeper:
            seeds = lms[sort_suffixes(names, depth, deeper)]
    else:
        seeds = lms[by_doubling(names, depth)]
    return _induce(t, is_s, seeds, folder)


def _piece_hashes(t: np.ndarray, is_s: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits, folded in pairs, of each piece's symbols and types."""
    from .common import mix, powers

    with np.errstate(over="ignore"):
        x = mix(t.astype(np.uint64) * np.uint64(2) + is_s + np.uint64(1))
        out = np.zeros(len(starts), dtype=np.uint64)
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            s = np.append(np.uint64(0), np.cumsum(x * powers(base, len(t)), dtype=np.uint64))
            piece = (s[starts + size] - s[starts]) * powers(pow(base, -1, 1 << 64), len(t))[starts]
            out = mix(out ^ piece)
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For every neighbour pair of ``order``, whether the first ``limit`` bytes agree
    (and are there). Eight bytes at a time, only for pairs that agree so far."""
    n = len(t)
    padded = np.append(t, np.zeros(limit + 8, dtype=np.uint8)).astype(np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, shape=(n + limit, 8), strides=(1, 1))
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    live = np.flatnonzero((a + limit <= n) & (b + limit <= n))
    offsets = [*range(0, limit - 7, 8)] + ([limit - 8] if limit % 8 else [])
    for off in offsets:
        if len(live) == 0:
            break
        live = live[(words[a[live] + off] == words[b[live] + off]).all(axis=1)]
    out = np.zeros(len(a), dtype=bool)
    out[live] = True
    return out
