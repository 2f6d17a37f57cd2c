"""Exact substring dedup over bytes with suffix arrays of shards.

Every byte covered by a ``width``-byte string that starts anywhere else is
removed, on all sides of the repeat.

1. As in the word-window operator, a string's anchor is the smallest hash of its
   ``anchor``-byte runs and a merged count-min sketch of anchors, which never
   falls short, tells which strings can't repeat. Rows with equal whole texts
   were matched by hash before, and one of them stands for all.
2. The stretches around anchors that may repeat (the starts an anchor answers
   for, plus ``width - 1`` bytes) go to the shard of the anchor: equal strings
   have equal anchors, so all their places meet there. Equal stretches are merged
   in the chunk first, then in the shard.
3. A shard's stretches form one text whose suffixes are sorted by induced sorting
   with disk-backed queues (``induced_sort``). Neighbours in that order with a
   common prefix of ``width`` bytes or more are repeats.
   A shard of more than ``hot_bytes`` (a passage that very many documents hold in
   different surroundings) is never held by a task: its starts are grouped by the
   128-bit hash of their ``width`` bytes, added up within each chunk first.
4. The starts found go back to the chunks, which cut their texts.

Defined results: null text is empty; texts shorter than ``width`` lose nothing;
equal rows are repeats of one another, whatever their doc_id; matches never cross
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, covered, mix, prepare, runs, slices, stored
from .induced_sort import common_prefixes, sort_suffixes
from .substring_dedup import CHUNK_BYTES, Sketch, anchors, chunk_count

WIDTH = 200                 # fixed value (contract)
ANCHOR = 32
SHARD_BYTES = 2 << 20       # text bytes for which there is one shard
HOT_BYTES = 8 << 20         # stretches a shard may hold to be sorted by one task
BASE = 0xD6E8FEB86659FD93
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
_SLICE = 1 << 20


class _Bytes:
    """Bytes of one slice of texts and their symbol hashes."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.raw = b"".join(texts)
        self.x = _BYTE_HASH[np.frombuffer(self.raw, dtype=np.uint8)]

    def starts(self, width: int) -> np.ndarray:
        per = np.maximum(0, self.sizes - width + 1)
        ends = np.cumsum(per)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins - (ends - per), per)


def _slices(table: pa.Table, skip: set[int], width: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    rows, texts = table.column("rid").to_pylist(), table.column("text")
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy())
    for a, b in slices(lengths, _SLICE):
        part, seen = [], set()
        for r, t in zip(rows[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
            if t and len(t) >= width and r not in skip and r not in seen:
                seen.add(r)
                part.append((r, t))
        if part:
            yield np.array([r for r, _ in part], dtype=np.int64), [t for _, t in part]


def _skipped(notes: pa.Table) -> set[int]:
    """Rows that another row with the same text stands for."""
    return set(notes.filter(pa.compute.equal(notes.column("block"), -1)).column("doc_id").to_pylist())


def split_hot(parts: DataFrame, hot_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The stretches of the shards that one task may hold, and of the others."""
    dealt = parts.filter("shard >= 0")
    hot = F.broadcast(dealt.groupBy("shard").agg(F.sum(F.octet_length("data")).alias("n")).filter(F.col("n") > hot_bytes)
                      .select("shard"))                     # at most one number a ``hot_bytes`` of stretches
    return dealt.join(hot, "shard", "left_anti"), dealt.join(hot, "shard", "left_semi")


def hot_repeats(hot: DataFrame, width: int) -> DataFrame:
    """(chunk, rid, data) of the repeated starts of hot shards; no key has more rows than there are chunks, or than a chunk holds."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("data") - F.lit(width)))
    starts = hot.select("chunk", "rid", "start", "known", "data", at.alias("i"))
    string = F.substring("data", F.col("i") + 1, F.lit(width))
    starts = starts.select("chunk", "rid", (F.col("start") + F.col("i")).alias("start"), "known",
                           F.xxhash64(string).alias("a"), F.xxhash64(F.lit(7), string).alias("b"))
    by_chunk = starts.groupBy("chunk", "a", "b").agg(F.count("*").alias("c"), F.max("known").alias("known"))
    many = by_chunk.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("known").alias("known")).filter("c > 1 or known").select("a", "b")
    told = by_chunk.select("chunk", "a", "b").join(many, ["a", "b"])
    found = starts.filter("not known").join(told, ["chunk", "a", "b"]).select("chunk", "rid", "start")    # known ones are marked in their chunk

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, rid, start = (batch.column(k).to_numpy() for k in range(3))
            order = np.lexsort((rid, chunk))
            chunk, rid, start = chunk[order], rid[order], start[order].astype(np.int32)
            cut, end = runs(chunk, rid)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cut], pa.int32()), pa.array(rid[cut], pa.int64()), pa.array(
                [start[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary())], names=["chunk", "rid", "data"])

    return found.mapInArrow(pack, "chunk int, rid long, data binary")


def dedup_bytes(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES,
                shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for every row of ``docs``."""
    prepare(docs)
    text = F.col("text").cast("binary")
    chunks, total = chunk_count(docs, chunk_bytes)
    shards = max(1, -(-total // shard_bytes))
    sketch = Sketch(total * 2 // (width - anchor + 2) + 1)
    ab = [F.xxhash64("text"), F.xxhash64(F.lit(7), "text")]
    rid = F.xxhash64("doc_id", *ab)
    dealt = docs.select(F.pmod(rid, F.lit(chunks)).cast("int").alias("chunk"), rid.alias("rid"), F.col("doc_id").cast("long"), text.alias("text"))
    grouped = dealt.groupBy("chunk")

    # rows whose whole text is there more than once: all go; the least row id stands for them
    whole = docs.filter(F.octet_length(text) >= width).select(rid.alias("rid"), ab[0].alias("a"), ab[1].alias("b"), F.octet_length(text).alias("n"))
    many = whole.groupBy("a", "b", "n").agg(F.min("rid").alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = stored(whole.join(many, ["a", "b", "n"]).groupBy("rid").agg(F.min("first").alias("first")).select(
        F.pmod("rid", F.lit(chunks)).cast("int").alias("chunk"), F.col("rid").alias("doc_id"),
        F.when(F.col("rid") == F.col("first"), -2).otherwise(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("data")), "copies")

    def local_sketch(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, hasher, found = _skipped(notes), WindowHash(BASE), []
        for _, texts in _slices(table, skip, width):
            w = _Bytes(texts)
            place, h = anchors(w, w.starts(width), width, anchor, hasher)
            found.append(h[np.append(True, place[1:] != place[:-1])])
        return sketch.table(key[0].as_py(), np.concatenate(found) if found else np.zeros(0, np.uint64))

    sketches = grouped.cogroup(copies.groupBy("chunk")).applyInArrow(local_sketch, "block long, chunk int, cells binary, more binary")
    hot = sketches.groupBy("block").applyInArrow(lambda t: sketch.merge_block(t), "chunk int, doc_id long, block long, data binary")

    def stretches(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        skip, hasher, marked = _skipped(notes), WindowHash(BASE), sketch.marked(notes)
        found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for rows, texts in _slices(table, skip, width):
            w = _Bytes(texts)
            starts = w.starts(width)
            place, h = anchors(w, starts, width, anchor, hasher)
            cut, end = runs(place)
            keep = sketch.repeated(marked, h[cut])
            cut, end = cut[keep], end[keep]
            first, n = starts[cut], end - cut
            owner = np.searchsorted(w.ends, first, side="right")
            for s, k, o, v in zip(first.tolist(), n.tolist(), owner.tolist(), (h[cut] % np.uint64(shards)).tolist(), strict=True):
                found.setdefault((v, w.raw[s:s + k + width - 1]), []).append((int(rows[o]), s - int(w.begins[o]), k))
        keys = list(found)
        lead = [found[k][0] for k in keys]
        local: dict[int, list[np.ndarray]] = {}
        for k in keys:
            if len(found[k]) > 1:
                for r, s, n in found[k]:
                    local.setdefault(r, []).append(np.arange(s, s + n, dtype=np.int32))
        m = len(local)
        return pa.table({
            "shard": pa.array([k[0] for k in keys] + [-1] * m, pa.int64()),
            "chunk": pa.array([key[0].as_py()] * (len(keys) + m), pa.int32()),
            "rid": pa.array([x[0] for x in lead] + list(local), pa.int64()),
            "start": pa.array([x[1] for x in lead] + [0] * m, pa.int32()),
            "known": pa.array([len(found[k]) > 1 for k in keys] + [True] * m, pa.bool_()),
            "data": pa.array([k[1] for k in keys] + [np.concatenate(x).tobytes() for x in local.values()], pa.binary())})

    schema = "shard long, chunk int, rid long, start int, known boolean, data binary"
    parts = stored(grouped.cogroup(hot.unionByName(copies).groupBy("chunk")).applyInArrow(stretches, schema), "stretches")

    def sort_shard(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("chunk").to_pylist(), table.column("rid").to_pylist(), table.column("start").to_pylist(),
                        table.column("known").to_pylist(), table.column("data").to_pylist(), strict=True))
        same: dict[bytes, list[int]] = {}
        for k, r in enumerate(rows):
            same.setdefault(r[4], []).append(k)
        texts = list(same)
        t = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8)
        sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        counts = sizes - width                        # starts of a stretch: size - 1 - (width - 1)
        valid = np.zeros(len(t), dtype=bool)
        at = np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
        valid[at] = True
        order = sort_suffixes(t, width)
        order = order[valid[order]]
        equal = common_prefixes(t, order, width)
        repeated = np.zeros(len(t), dtype=bool)
        repeated[order[:-1][equal]] = True
        repeated[order[1:][equal]] = True
        chunk, rid, starts = [], [], []
        for x, b, n in zip(texts, begins.tolist(), counts.tolist(), strict=True):
            places = same[x]
            if len(places) > 1 or rows[places[0]][3]:
                found = np.arange(n, dtype=np.int32)
            else:
                found = np.flatnonzero(repeated[b:b + n]).astype(np.int32)
            if len(found):
                for k in places:
                    if not rows[k][3]:
                        chunk.append(rows[k][0])
                        rid.append(rows[k][1])
                        starts.append((found + np.int32(rows[k][2])).tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "rid": pa.array(rid, pa.int64()), "data": pa.array(starts, pa.binary())})

    cold, hot_parts = split_hot(parts, hot_bytes)
    found = cold.groupBy("shard").applyInArrow(sort_shard, "chunk int, rid long, data binary")
    gone = (found.unionByName(hot_repeats(hot_parts, width)).unionByName(parts.filter("shard < 0").select("chunk", "rid", "data"))
            .unionByName(copies.select("chunk", F.col("doc_id").alias("rid"), F.lit(None).cast("binary").alias("data"))))

    def cut_texts(table: pa.Table, marks: pa.Table) -> pa.Table:
        starts: dict[int, list[np.ndarray]] = {}
        copied: set[int] = set()
        for r, data in zip(marks.column("rid").to_pylist(), marks.column("data").to_pylist(), strict=True):
            if data is None:
                copied.add(r)
            else:
                starts.setdefault(r, []).append(np.frombuffer(data, np.int32))
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for r, t in zip(table.column("rid").to_pylist(), table.column("text").to_pylist(), strict=True):
            t = t or b""
            removed, spans, rest = 0, 0, t
            if r in copied:
                removed, spans, rest = len(t), 1, b""
            elif r in starts:
                mask = covered(np.concatenate(starts[r]).astype(np.int64), width, len(t))
                removed = int(mask.sum())
                spans = int((np.diff(mask.astype(np.int8)) == 1).sum()) + int(mask[0])
                rest = np.frombuffer(t, np.uint8)[~mask].tobytes()
            n_bytes.append(len(t))
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(rest)
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return grouped.cogroup(gone.groupBy("chunk")).applyInArrow(
        cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
