"""Substring dedup over word windows with a count-min prefilter.

Documents are dealt into chunks of bounded text size. Each window of ``width``
words has an anchor, the smallest hash among its ``anchor``-word runs; a repeated
window repeats its anchor, so an anchor's count is never below its window's, and
there are several times fewer anchors than windows.

1. Every chunk makes its own count-min sketch of its anchors, kept sparse: the
   occupied cells by block of the sketch. Equal whole documents were found
   before by hash, and only their first copy takes part.
2. Sketches are merged block by block (a block has a fixed number of cells, the
   number of blocks follows the input). Cells with a merged count of two or more
   go back to the chunks that asked. The estimate of a window is the least of its
   anchor's cells, so it never falls short: no repeated window is lost.
3. Windows estimated as repeated are grouped exactly by a 128-bit hash: first in
   the chunk, where only the first of each passes on, then over all chunks.
4. Every chunk removes the words covered by a window that starts earlier too.

Text is shuffled by chunk (never by content), so a hot passage or a large group
of copies spreads over all chunks and adds at most one row a chunk to its key.

Defined results: null text has no words; fewer than ``width`` words hold no
window and lose nothing; rows that share a doc_id are told apart by their text
and neither is earlier than the other; rows with a null doc_id are no document: they lose nothing and count
for nothing. Words are bytes between ASCII white space, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WindowHash, WordHashes, as_bytes, covered, mix, prepare, runs, slices, stored

WIDTH = 20                  # fixed value (contract)
ANCHOR = 8
CHUNK_BYTES = 8 << 20
DEPTH = 2                   # rows of the sketch
CELLS_PER_ANCHOR = 8        # width of a row over the expected anchors
BLOCK_CELLS = 1 << 22
BASE1, BASE2, BASE3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

_POSITION_BITS = np.uint64(28)


class _Words:
    """Word hashes of one slice of documents, and the window starts inside them."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.x = np.concatenate([hashes.array(w) for w in words]) if words else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)

    def starts(self, width: int) -> np.ndarray:
        at = np.arange(max(0, len(self.x) - width + 1))
        return at[at + width <= self.ends[self.owner[at]]] if len(at) else at


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """min over a[i : i + n] for every i, by doubling."""
    out, have = a, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(w: _Words, starts: np.ndarray, width: int, anchor: int, hasher: WindowHash) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor, its hash) of every window start; the place is the
    leftmost smallest, so equal windows have it at the same offset."""
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64)
    g = hasher(w.x, anchor)
    key = (g >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(g), dtype=np.uint64)
    place = (sliding_min(key, width - anchor + 1)[starts] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    return place, g[place]


class Sketch:
    """Layout of a count-min sketch: rows of cells in blocks."""

    def __init__(self, expected: int, depth: int = DEPTH, cells_per_anchor: int = CELLS_PER_ANCHOR, block_cells: int = BLOCK_CELLS):
        self.depth = depth
        self.width = 1 << max(16, (max(1, expected) * cells_per_anchor - 1).bit_length())
        self.block = min(block_cells, self.width)
        self.blocks = self.width // self.block

    def cells(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per row: (block number over all rows, cell in the block)."""
        for row in range(self.depth):
            c = mix(hashes ^ np.uint64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1)) & np.uint64(self.width - 1)
            yield (c // np.uint64(self.block)).astype(np.int64) + row * self.blocks, (c % np.uint64(self.block)).astype(np.uint32)

    def table(self, chunk: int, hashes: np.ndarray) -> pa.Table:
        """One chunk's sketch: per block the occupied cells, and which were hit more than once."""
        blocks, once, more = [], [], []
        for block, cell in self.cells(hashes) if len(hashes) else ():
            order = np.lexsort((cell, block))
            block, cell = block[order], cell[order]
            for a, b in zip(*runs(block), strict=True):
                c, n = np.unique(cell[a:b], return_counts=True)
                blocks.append(int(block[a]))
                once.append(c.tobytes())
                more.append(np.flatnonzero(n > 1).astype(np.uint32).tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "chunk": pa.array([chunk] * len(blocks), pa.int32()),
                         "cells": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary())})

    def merge_block(self, table: pa.Table) -> pa.Table:
        """All chunks' parts of one block: back to each chunk go its cells with a merged count of two or more."""
        counts = np.zeros(self.block, dtype=np.uint8)
        parts = [np.frombuffer(c, np.uint32) for c in table.column("cells").to_pylist()]
        for c, m in zip(parts, table.column("more").to_pylist(), strict=True):
            counts[c] = np.minimum(counts[c] + 1, 2)
            counts[c[np.frombuffer(m, np.uint32)]] = 2
        hot = pa.array([c[counts[c] > 1].tobytes() for c in parts], pa.binary())
        out = pa.table({"chunk": table.column("chunk"), "doc_id": pa.nulls(len(parts), pa.int64()), "block": table.column("block"), "data": hot})
        return out.filter(pa.compute.greater(pa.compute.binary_length(hot), 0))

    def marked(self, notes: pa.Table) -> list[np.ndarray]:
        """Per row the sorted cells that came back to a chunk (rows of block -1 are other notes)."""
        cells = notes.filter(pa.compute.greater_equal(notes.column("block"), 0))
        rows: list[list[np.ndarray]] = [[] for _ in range(self.depth)]
        for block, data in zip(cells.column("block").to_pylist(), cells.column("data").to_pylist(), strict=True):
            row, at = divmod(block, self.blocks)
            rows[row].append(np.frombuffer(data, np.uint32).astype(np.uint64) + np.uint64(at * self.block))
        return [np.sort(np.concatenate(r)) if r else np.zeros(0, np.uint64) for r in rows]

    def repeated(self, marked: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """Which hashes have an estimate (the least of their cells) of two or more."""
        keep = np.ones(len(hashes), dtype=bool)
        for row, (block, cell) in enumerate(self.cells(hashes)):
            if not len(marked[row]):
                return np.zeros(len(hashes), dtype=bool)
            value = (block - row * self.blocks).astype(np.uint64) * np.uint64(self.block) + cell
            at = np.minimum(np.searchsorted(marked[row], value), len(marked[row]) - 1)
            keep &= marked[row][at] == value
        return keep


def _slices(table: pa.Table, copies: set[int]) -> Iterator[tuple[list[tuple[int, int]], list[list[bytes]]]]:
    """((row id, doc id) pairs, words) of a chunk's documents that take part, in bounded slices."""
    ids, texts = list(zip(table.column("rid").to_pylist(), table.column("doc_id").to_pylist(), strict=True)), table.column("text")
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())
    for a, b in slices(lengths, SLICE_BYTES // 2):
        part = [(d, t.split()) for d, t in zip(ids[a:b], texts.slice(a, b - a).to_pylist(), strict=True)
                if t and d[0] is not None and d[0] not in copies]
        if part:
            yield [d for d, _ in part], [w for _, w in part]


def _copies(notes: pa.Table) -> set[int]:
    """Row ids (under the notes' name doc_id) of the whole copies."""
    return set(notes.filter(pa.compute.equal(notes.column("block"), -1)).column("doc_id").to_pylist())


def row_id() -> Column:
    """A number for doc_id and text together; null without a doc_id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(7), "text")))


def repeated_copies(docs: DataFrame) -> DataFrame:
    """rid of every row whose whole text has been there with a smaller doc_id (pre-aggregated by hash)."""
    hashed = docs.filter("doc_id is not null and text is not null").select(
        row_id().alias("rid"), "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"), F.octet_length("text").alias("n"))
    firsts = hashed.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    return hashed.join(firsts, ["a", "b", "n"]).filter("doc_id > first").select("rid").distinct()


def chunk_of(rid: Column, chunks: int) -> Column:
    return F.pmod(rid, F.lit(chunks)).cast("int")


def chunk_count(docs: DataFrame, chunk_bytes: int) -> tuple[int, int]:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // chunk_bytes)), total


def dedup_substrings(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES,
                     depth: int = DEPTH, cells_per_anchor: int = CELLS_PER_ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): one row for every row of ``docs``."""
    prepare(docs)
    base = docs.select(F.col("doc_id").cast("long"), "text")
    chunks, total = chunk_count(base, chunk_bytes)
    # about 6 bytes a word; 2 anchors in width - anchor + 2 places
    sketch = Sketch(total // (3 * (width - anchor + 2)) + 1, depth, cells_per_anchor)
    # a null doc_id takes no part; its rows are spread by text
    chunk = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int")).otherwise(chunk_of(row_id(), chunks))
    dealt = base.select(chunk.alias("chunk"), row_id().alias("rid"), "doc_id", as_bytes("text"))
    copies = stored(repeated_copies(base).select(chunk_of(F.col("rid"), chunks).alias("chunk"), F.col("rid").alias("doc_id"),
                                                 F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("data")), "copies")
    grouped = dealt.groupBy("chunk")

    def local_sketch(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, hashes, hasher = _copies(notes), WordHashes(), WindowHash(BASE3)
        found = []
        for _, words in _slices(table, skip):
            w = _Words(words, hashes)
            place, h = anchors(w, w.starts(width), width, anchor, hasher)
            if len(place):
                found.append(h[np.concatenate([[True], place[1:] != place[:-1]])])   # places never go back
        return sketch.table(key[0].as_py(), np.concatenate(found) if found else np.zeros(0, np.uint64))

    sketches = grouped.cogroup(copies.groupBy("chunk")).applyInArrow(local_sketch, "block long, chunk int, cells binary, more binary")

    kind = "chunk int, doc_id long, block long, data binary"
    hot = sketches.groupBy("block").applyInArrow(lambda t: sketch.merge_block(t), kind)

    def candidates(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, hashes, hasher = _copies(notes), WordHashes(), WindowHash(BASE3)
        first, second = WindowHash(BASE1), WindowHash(BASE2)
        marked = sketch.marked(notes)
        h1, h2, rid, doc, at = [], [], [], [], []
        for ids, words in _slices(table, skip):
            w = _Words(words, hashes)
            starts = w.starts(width)
            place, h = anchors(w, starts, width, anchor, hasher)
            keep = sketch.repeated(marked, h)
            starts = starts[keep]
            if len(starts):
                owner = w.owner[starts]
                h1.append(first(w.x, width)[starts])
                h2.append(second(w.x, width)[starts])
                both = np.array(ids, dtype=np.int64)[owner]
                rid.append(both[:, 0])
                doc.append(both[:, 1])
                at.append(starts - w.begins[owner])
        if not h1:
            return _removals(key, [], [], [], [], [], [])
        h1, h2, rid, doc, at = (np.concatenate(v) for v in (h1, h2, rid, doc, at))
        order = np.lexsort((at, rid, doc, h2, h1))
        h1, h2, rid, doc, at = h1[order], h2[order], rid[order], doc[order], at[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        row = new | np.concatenate([[True], rid[1:] != rid[:-1]])              # a row is in one chunk: its first place is here
        first_at = at[np.flatnonzero(row)[np.cumsum(row) - 1]]
        later = (doc != doc[lead]) | (at != first_at)      # not the first document of the chunk, or not its first place
        one = row & ~later
        local_rid, local_at = rid[later], at[later]
        by = np.lexsort((local_at, local_rid))
        local_rid, local_at = local_rid[by], local_at[by]
        cut, end = runs(local_rid)
        pieces = [local_at[a:b].astype(np.int32).tobytes() for a, b in zip(cut, end, strict=True)]
        return _removals(key, h1[one].view(np.int64), h2[one].view(np.int64), rid[one], doc[one], at[one], list(zip(local_rid[cut].tolist(), pieces, strict=True)))

    places = stored(grouped.cogroup(hot.unionByName(copies).groupBy("chunk")).applyInArrow(
        candidates, "h1 long, h2 long, chunk int, rid long, doc_id long, start int, local binary"), "windows")
    # a window's first document by a partial aggregate, then a join that Spark can split:
    # a passage that is everywhere is never one task's work
    seen = places.filter("local is null")
    firsts = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    later = (seen.join(firsts, ["h1", "h2"]).filter("doc_id > first")
             .select("chunk", "rid", "start", F.lit(None).cast("binary").alias("local")))
    gone = later.unionByName(places.filter("local is not null").select("chunk", "rid", "start", "local")).unionByName(
        copies.select("chunk", F.col("doc_id").alias("rid"), F.lit(-1).alias("start"), F.lit(None).cast("binary").alias("local")))

    def cut_texts(key, table: pa.Table, marks: pa.Table) -> pa.Table:
        gone: dict[int, list] = {}
        whole: set[int] = set()
        single = marks.filter(pa.compute.greater_equal(marks.column("start"), 0))
        d, s = single.column("rid").to_numpy(), single.column("start").to_numpy()
        by = np.argsort(d, kind="stable")
        d, s = d[by], s[by]
        for a, b in zip(*runs(d), strict=True):
            gone[int(d[a])] = [s[a:b]]
        other = marks.filter(pa.compute.less(marks.column("start"), 0))
        for rid, local in zip(other.column("rid").to_pylist(), other.column("local").to_pylist(), strict=True):
            if local is None:
                whole.add(rid)
            else:
                gone.setdefault(rid, []).append(np.frombuffer(local, np.int32))
        ids = table.column("doc_id").to_pylist()
        n_words, n_removed, kept = [], [], []
        for rid, text in zip(table.column("rid").to_pylist(), table.column("text").to_pylist(), strict=True):
            words = (text or b"").split()
            removed = 0
            if rid in whole and len(words) >= width:
                removed, words_left = len(words), []
            elif rid in gone:
                mask = covered(np.concatenate(gone[rid]).astype(np.int64), width, len(words))
                removed = int(mask.sum())
                words_left = [x for x, m in zip(words, mask.tolist(), strict=True) if not m]
            else:
                words_left = words
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(b" ".join(words_left))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary())})

    out = grouped.cogroup(gone.groupBy("chunk")).applyInArrow(cut_texts, "doc_id long, n_words long, n_removed long, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def _removals(key, h1, h2, rid, doc, at, local: list[tuple[int, bytes]]) -> pa.Table:
    """First windows of a chunk, then per row the starts found later in the chunk itself."""
    n, m = len(h1), len(local)
    return pa.table({
        "h1": pa.concat_arrays([pa.array(h1, pa.int64()), pa.nulls(m, pa.int64())]),
        "h2": pa.concat_arrays([pa.array(h2, pa.int64()), pa.nulls(m, pa.int64())]),
        "chunk": pa.array(np.full(n + m, key[0].as_py(), dtype=np.int32)),
        "rid": pa.concat_arrays([pa.array(rid, pa.int64()), pa.array([r for r, _ in local], pa.int64())]),
        "doc_id": pa.concat_arrays([pa.array(doc, pa.int64()), pa.nulls(m, pa.int64())]),
        "start": pa.concat_arrays([pa.array(np.asarray(at, dtype=np.int32)), pa.array(np.full(m, -1, dtype=np.int32))]),
        "local": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x for _, x in local], pa.binary())])})
