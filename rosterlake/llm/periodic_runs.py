"""Runs of a repeated word pattern, by longest common extensions (LCE).

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the
same), at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words long, that no neighbouring
word extends. Each task numbers the words of a slice of documents; every document is
closed by a number of its own, so nothing matches across documents.

Harmonic grid: for each period ``q`` the places 0, q, 2q, ... are compared with the
places ``q`` further on: N/1 + N/2 + ... comparisons, as strided arrays. The first grid
place inside a run has more than 2q words that go on equally, so pairs whose first three
words differ are out at once, and the others are kept if their LCE exceeds 2q. A run's
end follows from that LCE; its start lies less than ``q`` before that place and is found
by halving with further LCEs. Of the periods found for one stretch the smallest is its own
(a shorter period of a stretch four periods long divides the longer one).

LCE by difference cover: of every 7 places those numbered 1, 2 and 4 are sampled; any
two places have a common distance below 7 to sampled ones. Only sampled suffixes are
sorted (by doubling), their neighbours' common prefixes go into a sparse table, and
an LCE compares fewer than 7 words and then takes one minimum from the table. The
structure is built for documents that have a pair left after the word comparison.

Memory is bounded by the slice, or by the longest document if that is longer. Defined
results: a null or empty text has no words, no runs, four nulls and the digest of an
empty text. Each row is judged by itself, so repeated rows and rows sharing a doc_id get
a result each; other columns are kept as they are and give way to result columns of the
same name. Of runs of equal length the smallest start, then period is the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, plus, prepare, ranges, text_slices

MIN_EXPONENT, MIN_LENGTH = 4, 6
COVER = 7
SAMPLE = (1, 2, 4)            # each distance modulo COVER is a difference of two of these
SLICE = 2 << 20               # text bytes judged at a time
MAX_PAIRS = 1 << 19           # grid pairs held before they are judged
# the smallest distance from places i, j (modulo COVER) to sampled ones
_SHIFT = np.array([[next(d for d in range(COVER) if (i + d) % COVER in SAMPLE and (j + d) % COVER in SAMPLE)
                    for j in range(COVER)] for i in range(COVER)])
_SLOT = np.array([SAMPLE.index(r) if r in SAMPLE else -1 for r in range(COVER)])
_RESULT = {"n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long",
           "runs": "array<struct<start:long,length:long,period:long>>", "kept_text": "string"}


class Lce:
    """Longest common extension to the right of any two places of ``words``, whose
    last word occurs once."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        place = (COVER * np.arange(n // COVER + 1)[:, None] + np.array(SAMPLE)).ravel()
        place = place[place < n]
        self.words = np.append(words, np.zeros(2 * COVER, dtype=words.dtype))
        levels = [self._names(place)]
        size, step = len(place), len(SAMPLE)
        while size and int(levels[-1].max()) + 1 < size:           # ranks by twice as many words
            rest = np.zeros(size, dtype=np.int64)
            rest[:max(size - step, 0)] = levels[-1][step:].astype(np.int64) + 1
            levels.append(_dense(levels[-1].astype(np.int64) * (size + 1) + rest))
            step *= 2
        self.rank = levels.pop()
        self.table = self._minima(self._neighbours(place, levels))

    def _names(self, place: np.ndarray) -> np.ndarray:
        """Ranks of the sampled places by their next COVER words."""
        rank, base = np.zeros(len(place), dtype=np.int64), int(self.words.max(initial=0)) + 2
        for k in range(COVER):
            rank = _dense(rank.astype(np.int64) * base + self.words[place + k] + 1)
        return rank

    def _neighbours(self, place: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of the suffixes that are neighbours in their order."""
        size = len(place)
        order = np.empty(size, dtype=np.int64)
        order[self.rank] = np.arange(size)
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(max(size - 1, 0), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < size
            eq = np.zeros(len(a), dtype=bool)
            eq[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            same[eq] += COVER << k
            a[eq] += len(SAMPLE) << k
            b[eq] += len(SAMPLE) << k
        a, b = place[order[:-1]], place[order[1:]]
        open_ = np.arange(len(a))
        for _ in range(COVER):
            open_ = open_[self.words[a[open_] + same[open_]] == self.words[b[open_] + same[open_]]]
            same[open_] += 1
        return same

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        """Row k holds the minimum of each 2**k values from a place on."""
        n = len(values)
        out = np.zeros((max(n.bit_length(), 1), n), dtype=np.int64 if n >= 1 << 31 else np.int32)
        out[0] = values
        for k in range(1, n.bit_length()):
            h = 1 << (k - 1)
            out[k, :n - 2 * h + 1] = np.minimum(out[k - 1, :n - 2 * h + 1], out[k - 1, h:n - h + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        words, shift = self.words, _SHIFT[i % COVER, j % COVER]
        out = np.zeros(len(i), dtype=np.int64)
        alive = np.arange(len(i))
        for k in range(COVER - 1):                                 # to the next places sampled for both
            alive = alive[shift[alive] > k]
            alive = alive[words[i[alive] + k] == words[j[alive] + k]]
            out[alive] += 1
        at = np.flatnonzero(out == shift)
        a, b = i[at] + shift[at], j[at] + shift[at]
        a, b = (self.rank[x // COVER * len(SAMPLE) + _SLOT[x % COVER]].astype(np.int64) for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1       # floor of the binary logarithm
        out[at] += np.minimum(self.table[k, low], self.table[k, high - (np.int64(1) << k)])
        return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, by document and start. ``words``
    holds the documents' word numbers, 0 and up, one after another."""
    rank = np.argsort(-sizes, kind="stable")                       # long ones first: a period concerns a beginning
    size = sizes[rank]
    began = np.cumsum(sizes) - sizes
    head = np.cumsum(size + 1) - size - 1                          # where each document starts, with its closing number
    n = int(size.sum()) + len(size)
    w = np.empty(n + 2, dtype=np.int64)
    w[ranges(head, size)] = words[ranges(began[rank], size)]
    top = int(words.max(initial=-1)) + 1
    w[head + size] = top + np.arange(len(size))
    w[n:] = top + len(size) + np.arange(2)
    tail = head + size
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, ...]] = []
    state: dict = {}

    def judge(last: bool) -> None:
        if not pairs:
            return
        i, q = (np.concatenate(x) for x in zip(*pairs))
        pairs.clear()
        doc = np.searchsorted(head, i, side="right") - 1
        inside = i + q < tail[doc]
        i, q, doc = i[inside], q[inside], doc[inside]
        if "lce" not in state:                                     # only documents that have a pair, if all pairs are here
            use = np.unique(doc) if last else np.arange(len(head))
            state["at"] = np.full(len(head), -1, dtype=np.int64)
            state["at"][use] = np.cumsum(size[use] + 1) - size[use] - 1
            state["lce"] = Lce(w[ranges(head[use], size[use] + 1)])
        move, lce = (state["at"] - head)[doc], state["lce"]
        i = i + move
        more = lce(i, i + q)
        keep = more > 2 * q
        i, q, doc, move, end = i[keep], q[keep], doc[keep], move[keep], (i + q + more)[keep]
        order = np.lexsort((i, end, q))
        i, q, doc, move, end = (x[order] for x in (i, q, doc, move, end))
        first = np.ones(len(i), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (end[1:] != end[:-1])
        i, q, doc, move, end = (x[first] for x in (i, q, doc, move, end))
        low, high = np.maximum(i - q + 1, head[doc] + move), i.copy()
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) // 2
            ok = mid + lce(mid, mid + q[todo]) >= i[todo]
            high[todo] = np.where(ok, mid, high[todo])
            low[todo] = np.where(ok, low[todo], mid + 1)
        keep = end - low >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
        found.append(tuple(x[keep] for x in (doc, low - move - head[doc], end - low, q)))

    held = 0
    for q in range(1, int(size[0]) // MIN_EXPONENT + 1 if len(size) else 0):
        long = int(np.searchsorted(-size, -max(MIN_LENGTH, MIN_EXPONENT * q), side="right"))
        if not long:
            break
        grid = w[:tail[long - 1] + 1:q]
        i = np.flatnonzero(grid[1:] == grid[:-1]) * q
        if len(i):
            i = i[w[i + 1] == w[i + 1 + q]]
            i = i[w[i + 2] == w[i + 2 + q]]
            if len(i):
                pairs.append((i, np.full(len(i), q, dtype=np.int64)))
                held += len(i)
                if held >= MAX_PAIRS:
                    judge(False)
                    held = 0
    judge(not state)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    doc, start, length, q = (np.concatenate(x) for x in zip(*found))
    doc = rank[doc]
    order = np.lexsort((q, length, start, doc))
    doc, start, length, q = (x[order] for x in (doc, start, length, q))
    own = np.ones(len(doc), dtype=bool)                            # of one stretch's periods the smallest
    own[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, q = (x[own] for x in (doc, start, length, q))
    order = np.lexsort((q, start, doc))
    return tuple(x[order] for x in (doc, start, length, q))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def detect_runs(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, n_runs, the longest run's start, length and period (null
    without runs), runs (all of them, by start, then period) and kept_text (the words
    that lie in no run or in a run's first period, joined by one space). Words are what
    stands between U+0020 and U+0009 to U+000D."""
    prepare(docs)
    base = [f.name for f in docs.schema.fields if f.name not in _RESULT]
    df = docs.withColumn("_b_text", as_bytes("text")).select(*(f"`{c}`" for c in base), "_b_text")
    schema = plus(docs.select(*(f"`{c}`" for c in base)).schema, **_RESULT)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_b_text", SLICE):
                words = [(t or b"").split() for t in texts]
                sizes = np.array([len(x) for x in words], dtype=np.int64)
                number = _Numbers().__getitem__
                flat = np.fromiter((k for x in words for k in map(number, x)), dtype=np.int64, count=int(sizes.sum()))
                doc, start, length, q = find_runs(flat, sizes)
                edge = np.searchsorted(doc, np.arange(len(words) + 1))
                best = np.full(len(words), -1, dtype=np.int64)
                pick = np.lexsort((q, start, -length, doc))
                has = np.flatnonzero(np.diff(edge))
                best[has] = pick[edge[has]]
                none = best < 0
                kept = []
                for k, x in enumerate(words):
                    if not none[k]:
                        s = slice(edge[k], edge[k + 1])
                        drop = np.zeros(len(x) + 1, dtype=np.int64)
                        np.add.at(drop, start[s] + q[s], 1)
                        np.add.at(drop, start[s] + length[s], -1)
                        x = [x[p] for p in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
                    kept.append(b" ".join(x))
                one = [pa.array(np.where(none, 0, v[best]) if len(v) else np.zeros(len(words), np.int64), mask=none) for v in (start, length, q)]
                runs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in (start, length, q)], fields=list(kind)))
                cols = [pa.array(sizes), pa.array(np.diff(edge).astype(np.int64)), *one, runs, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(base))), *cols], names=[*base, *_RESULT])

    return df.mapInArrow(emit, schema)
