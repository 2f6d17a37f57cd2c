"""N-gram Jaccard self-join by vertical partitioning.

A document is its set of ``n``-word shingles, equal sets are one class. One global
order over all shingles (rare ones first: a shingle that many documents share
carries a frequency class, then its hash) is cut into fragments:

1. The head fragment of a set is its first ``size - ceil(t * size) + 1`` shingles
   in the global order; sets that link share at least one of them. Heads are
   matched by shingle, their partial overlap is counted per pair, and the pair
   goes on only if that count plus what the rest could still add reaches the
   threshold.
2. For the pairs left, each remaining fragment of the order is intersected by
   itself and the partial overlaps are summed per pair: the exact overlap.

Large groups of near copies aren't expanded into all pairs. A first round pairs
every class with one hub for each shared shingle, the class made most of common
shingles; the links found give components. A second round looks only at shingles
whose classes still lie in more than one component and pairs across components,
leaving out the shingle's largest component with itself. No link between two
components can be missed: it would share a head shingle, and that shingle's pairs
across components are all tried.

Frequency classes come from counts over all documents; they only set the order,
so any loss there (a bound on the list sent to the tasks) costs time, never links.

Defined results: text that is null or without words has an empty set, size 0 and
its own doc_id as component; rows with a null doc_id link with nothing and have a
null component; rows that share a doc_id are classed by their own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, as_bytes, discard, prepare, ranges, runs, stored, text_slices, word_hashes
from .components import components

N = 5                         # fixed value (contract)
PERCENT = 80                  # fixed value (contract)
FRAGMENTS = 4                 # of the shingles without a frequency class
CLASS_FRAGMENTS = 4           # of those with one: four classes each, the last takes the rest
MIN_COMMON = 16               # counted occurrences that give a shingle a frequency class
MAX_COMMON = 400_000          # shingles with a class (9 bytes each in a task)
COUNT_BUFFER = 2_000_000      # shingles counted at a time in a task
BASE = 0x9E3779B97F4A7C15

SLICE = 1 << 20               # text bytes whose shingles are made together

_CLASS_SHIFT = 57             # order key: class above, 57 bits of hash below
_SEEN_BITS = 22               # of a shingle, looked up before the list of those with a class


@dataclass
class Sets:
    """Shingle sets of some texts: set k is ``keys[starts[k]:starts[k] + sizes[k]]``, sorted."""

    keys: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes

    def each(self) -> Iterator[np.ndarray]:
        return (self.keys[a:a + k] for a, k in zip(self.starts.tolist(), self.sizes.tolist(), strict=True))


def word_sets(texts: list[bytes | None], n: int, hasher: WindowHash) -> Sets:
    """Distinct 57-bit shingle hashes of each text, A-Z in lower case."""
    x, words = word_hashes(texts)
    at = np.cumsum(words) - words
    sizes = np.where(words >= n, words - n + 1, np.minimum(words, 1))     # with repeats
    starts = np.cumsum(sizes) - sizes
    h = np.zeros(int(sizes.sum()), np.uint64)
    for k in np.unique(words[(words > 0) & (words < n)]).tolist():        # a short text is one shingle
        some = np.flatnonzero(words == k)
        h[starts[some]] = hasher(x[ranges(at[some], words[some])], k)[::k]
    some = np.flatnonzero(words >= n)
    if len(some):
        h[ranges(starts[some], sizes[some])] = hasher(x, n)[ranges(at[some], sizes[some])]
    h >>= np.uint64(64 - _CLASS_SHIFT)
    for a, k in zip(starts[some].tolist(), sizes[some].tolist(), strict=True):
        h[a:a + k].sort()
    first = np.diff(h, prepend=np.uint64(0)) != 0
    first[starts[sizes > 0]] = True
    total = np.concatenate([[0], np.cumsum(first)])
    return Sets(h[first], total[starts + sizes] - total[starts])


def common_shingles(docs: DataFrame, n: int = N, least: int = MIN_COMMON, most: int = MAX_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, class 1..): shingles of many documents. Every task counts
    its documents and passes on what it saw twice; Spark adds the counts."""
    prepare(docs)
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHash(BASE)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
            held.clear()
            begin, end = runs(h)
            twice = np.flatnonzero(end - begin > 1)
            return pa.RecordBatch.from_arrays([pa.array(h[begin[twice]].astype(np.int64)), pa.array((end - begin)[twice])], schema=schema)

        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE):
                held.append(word_sets(texts, n, hasher).keys)
                if sum(map(len, held)) > COUNT_BUFFER:
                    yield counted()
        yield counted()

    counts = (docs.select(as_bytes("text")).mapInArrow(emit, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
              .filter(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(most).toArrow())   # bounded by ``most``
    h, c = counts.column("h").to_numpy().astype(np.uint64), counts.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], np.minimum(60, np.log2(np.maximum(c[order], 1)).astype(np.int64) - int(math.log2(least)) + 1)


class Order:
    """The global order: class (0 where a shingle has none), then hash."""

    def __init__(self, common: np.ndarray, classes: np.ndarray):
        self.common, self.classes = common, classes
        self.seen = np.zeros(1 << _SEEN_BITS, bool)           # first bits of the shingles with a class
        self.seen[common >> np.uint64(_CLASS_SHIFT - _SEEN_BITS)] = True

    def keys(self, sets: Sets) -> Sets:
        """The order keys of each set, ascending."""
        out = sets.keys.astype(np.int64)
        maybe = np.flatnonzero(self.seen[sets.keys >> np.uint64(_CLASS_SHIFT - _SEEN_BITS)])
        if len(maybe):
            s = sets.keys[maybe]
            at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            is_common = self.common[at] == s
            maybe, at = maybe[is_common], at[is_common]
            out[maybe] |= self.classes[at] << _CLASS_SHIFT
            for k in np.unique(np.searchsorted(sets.starts, maybe, side="right") - 1).tolist():
                out[sets.starts[k]:sets.starts[k] + sets.sizes[k]].sort()
        return Sets(out, sets.sizes)


def head_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)


def fragments_of(keys: Sets, fragments: int) -> pa.ListArray:
    """The order keys of each set, cut where the global order is cut: ``fragments``
    ranges of the shingles without a class, then ``CLASS_FRAGMENTS`` of classes."""
    span = 1 << _CLASS_SHIFT
    cuts = [span * k // fragments for k in range(1, fragments + 1)] + [span * (1 + 4 * k) for k in range(1, CLASS_FRAGMENTS)]
    parts = len(cuts) + 1
    place = np.repeat(np.arange(len(keys.sizes)) * parts, keys.sizes) + np.searchsorted(np.array(cuts), keys.keys, side="right")
    sizes = np.bincount(place, minlength=parts * len(keys.sizes))
    return _lists(np.full(len(keys.sizes), parts), _lists(sizes, pa.array(keys.keys)))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sent, n: int, percent: int, fragments: int) -> DataFrame:
    """The pairs (x, y) that pass, by exact overlap: partial overlaps per fragment, summed.
    Stored; the tables on the way are removed."""
    pairs = stored(pairs.select("x", "y"), "pairs")
    ids = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).distinct()
    first = classes.join(ids, "cid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hasher = Order(*sent.value), WindowHash(BASE)
        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE):
                sets = word_sets([t for t in texts if t], n, hasher)
                real = np.flatnonzero(sets.sizes)
                sets = Sets(sets.keys, sets.sizes[real])
                cid = [set_id(s)[0] for s in sets.each()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid, pa.int64()), pa.array(sets.sizes, pa.int64()), fragments_of(order.keys(sets), fragments)],
                    names=["cid", "n", "keys"])

    parts = (docs.join(first, "doc_id", "left_semi").select(as_bytes("text"))
             .mapInArrow(emit, "cid long, n long, keys array<array<long>>").dropDuplicates(["cid"]))
    parts = stored(parts, "fragments")
    x = parts.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("keys").alias("kx"))
    y = parts.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("keys").alias("ky"))
    # one row a pair: the fragments are matched place by place and their counts added
    total = pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", F.aggregate(
        F.zip_with("kx", "ky", lambda p, q: F.size(F.array_intersect(p, q))), F.lit(0), lambda t, o: t + o).alias("o"))
    links = stored(total.filter(F.expr(f"100 * o >= {percent} * (nx + ny - o)"))
                   .select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    discard(pairs, parts)
    return links


def set_id(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _sets(docs: DataFrame, sent, n: int, percent: int) -> DataFrame:
    """One row a document: size, class id, share of common shingles, head in order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hasher = Order(*sent.value), WindowHash(BASE)
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                sets = word_sets(texts, n, hasher)
                ids = [set_id(s) if len(s) else (None, None) for s in sets.each()]
                keys = order.keys(sets)
                ranks = np.concatenate([[0], np.cumsum(keys.keys >> _CLASS_SHIFT)])
                share = (ranks[keys.starts + keys.sizes] - ranks[keys.starts]) / np.maximum(keys.sizes, 1)
                heads = head_sizes(keys.sizes, percent)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.sizes, pa.int64()), pa.array([i for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64()),
                     pa.array(share, pa.float64()), _lists(heads, pa.array(keys.keys[ranges(keys.starts, heads)]))],
                    names=["doc_id", "n", "cid", "check", "share", "head"])

    return docs.select("doc_id", as_bytes("text")).mapInArrow(
        emit, "doc_id long, n long, cid long, check long, share double, head array<long>")


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token has a neighbour; holds one row back."""
    held, held_shared = None, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = batch.column(0).to_numpy()
        same = t[1:] == t[:-1]
        shared = np.append(same, False) | np.append(False, same)
        if held is not None:
            if held.column(0)[0].as_py() == t[0]:
                held_shared = shared[0] = True
            if held_shared:
                yield held
        held, held_shared = batch.slice(batch.num_rows - 1), bool(shared[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(shared[:-1]))
    if held is not None and held_shared:
        yield held


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for every row of ``docs``."""
    spark = prepare(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(common_shingles(docs, n))
    rows = stored(_sets(docs, sent, n, percent), "sets")
    real = rows.filter("cid is not null and doc_id is not null")
    same = "min(check) = max(check)"      # two sets under one id would be a hash collision: stop, never mix
    classes = stored(real.groupBy("cid").agg(
        F.min("doc_id").alias("rep"),
        F.expr(f"if({same}, 0, raise_error('two shingle sets share a 64-bit id')) as ok")).drop("ok"), "classes")

    heads = (real.join(classes.select("cid", F.col("rep").alias("doc_id")), ["cid", "doc_id"])
             .select("cid", F.posexplode("head").alias("pos", "token")).select("token", "cid", "pos"))
    rare = F.shiftright("token", _CLASS_SHIFT) == 0
    matched = (heads.filter(rare).repartition("token").sortWithinPartitions("token")
               .mapInArrow(_keep_shared, "token long, cid long, pos int"))
    facts = real.join(classes.select("cid", F.col("rep").alias("doc_id")), ["cid", "doc_id"]).select(
        "cid", "n", "share")
    shared = stored(matched.unionByName(heads.filter(~rare)).join(facts.dropDuplicates(["cid"]), "cid"), "shared")
    sets, rows = rows, stored(rows.select("doc_id", "n", "cid"), "sizes")      # the heads are in ``shared`` now
    discard(sets)

    # round 1: every class with the hub of each of its shared shingles
    hubs = shared.groupBy("token").agg(F.max(F.struct("share", F.col("cid").alias("y"))).alias("hub")).select("token", "hub.y")
    hub_rows = shared.join(hubs, "token").filter("cid = y").select(
        "token", "y", F.col("n").alias("ny"), F.col("pos").alias("py"))
    left = shared.select("token", F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    near = left.join(hub_rows, "token").filter("x <> y")
    found = _links(_possible(near, percent), docs, classes, sent, n, percent, fragments)

    # round 2: pairs across the components of one shingle
    roots = stored(components(found), "roots")
    placed = stored(shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                    .withColumn("root", F.coalesce("root", "cid")), "placed")
    discard(shared, roots)
    mixed = (placed.groupBy("token", "root").agg(F.count("*").alias("c"))
             .groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("c", "root")).alias("top"))
             .filter("k > 1").select("token", F.col("top.root").alias("major")))
    there = placed.join(mixed, "token")
    side = lambda s: there.select("token", "major", F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"),
                                  F.col("root").alias(f"r{s}"))
    across = (side("x").filter("rx <> major").join(side("y").drop("major"), "token")
              .filter("rx <> ry and (ry = major or x < y)"))
    more = _links(_possible(across, percent), docs, classes, sent, n, percent, fragments)
    discard(placed)
    final = components(found.unionByName(more))

    whole = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "root").select("cid", "component_id")
    return (rows.join(named, "cid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")))


def _possible(matches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose partial overlap in the head fragment leaves the threshold in reach.

    ``matches`` has a row for each head shingle that x and y share, with its places.
    Sizes fix the least overlap, so a pair that links shares one of the first
    ``size - least + 1`` shingles on both sides; matches behind those places are left
    out. All matches up to the last one are counted, and what stands behind it on
    either side bounds the rest."""
    need = f"ceil({percent} * (nx + ny) / {100 + percent}D - 1e-9)"
    early = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and px <= nx - {need} and py <= ny - {need}"
    # one way round, so that a pair's matches are all counted together
    pick = lambda a, b: F.when(F.col("x") < F.col("y"), F.col(a)).otherwise(F.col(b))
    turned = matches.filter(early).select(*(pick(p + a, p + b).alias(p + a) for p in ("", "n", "p") for a, b in (("x", "y"), ("y", "x"))))
    sums = turned.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"), F.max("px").alias("px"), F.max("py").alias("py"))
    return sums.filter(f"c + least(nx - px - 1, ny - py - 1) >= {need}")
