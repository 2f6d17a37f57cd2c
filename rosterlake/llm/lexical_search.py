"""Ranked lexical search over an index of per-term geometric blocks.

Documents are indexed in shards of bounded size (as many as the data need). In a
shard each term's posting list is cut into blocks of similar documents: some of the
list's documents, evenly spaced, are centres, and every other one goes to the centre
with the nearest sketch (a fixed random projection of its term impacts). A block's
summary holds, for each term, the largest impact of its documents, so the summary's
score for a query is never below that of any of its documents.

A search takes the queries in blocks of bounded size. For each query it computes the
summary scores of its terms' blocks and opens blocks from the best on, scoring their
documents exactly; it stops where the next bound is below the k-th best score so far
(equal bounds are opened, so ties are whole). The k best so far go on from shard to
shard within a task. Tasks return at most k rows a query, which one ranked window
brings together.

The score is a sum of integers: a term's weight times
``(10**9 * tf) div (1000 * tf + 8 * m)``, with the weight and the length norm ``m`` from
counts over all documents. An index is built for a vocabulary: the terms of a stated query
set, passed to the tasks as a bitmap of fixed size (a term that passes it by chance
is indexed and never asked for). Term numbers are a shard's own, and terms are compared
as bytes.

Defined results: null and empty texts have no terms, so as documents they are never
found and don't count, and as queries they find nothing. Each document row is a
document of its own, also among rows that share a doc_id; equal scores are ordered by
doc_id, nulls last. Equal query rows are one query; rows that share an id but not a
text are queries of their own, each with its own ranks. Other columns are not used.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, prepare, ranges, stored, text_slices

TOP = 10
SHARD_DOCUMENTS = 8192
SHARD_POSTINGS = 200_000
ROWS_PER_FILE = 2             # index rows of some ten megabytes
BLOCK = 256                   # documents a block has on average, in a long list
SKETCH = 32                   # dimensions of the sketches that blocks are formed by
QUERY_TERMS = 200_000         # query terms sent to the tasks at a time
FILTER_BITS = 1 << 20
KNOWN_WORDS = 500_000         # remembered answers of the bitmap in a worker
FIRST_DOCUMENTS = 64          # documents opened before the first look at the k-th best
QUERY, TERM, RANK = "_query", "_term", "rank"
# Fixed value: bytes that belong to a term; capitals count as small letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

# A shard is one row. Its number arrays are 32-bit, little-endian and compressed: as Spark
# arrays, the thousands of rows that a Parquet reader holds would be far larger than a task.
_LISTS = {"doc_ids": "array<long>", "vocabulary": "array<binary>", "documents": "array<int>"}
_PACKED = ("first", "term", "impact", "block_term", "member_first", "members", "summary_first", "summary_block", "summary_max")
_INDEX = ", ".join([*(f"{c} {t}" for c, t in _LISTS.items()), *(f"{c} binary" for c in _PACKED)])
_CODEC = "zstd"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class _Passed(dict):
    """term -> itself if the bitmap has it, else an empty string."""

    def __init__(self, bits: np.ndarray | None):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = self[term] = term if self.bits is None or self.bits[zlib.crc32(term) % FILTER_BITS] else b""
        return out


def term_counts(docs: DataFrame, bitmap=None) -> DataFrame:
    """``docs`` without its text plus n (terms with repeats), terms and tfs (the
    distinct terms that the broadcast bitmap lets through, with their counts)."""
    prepare(docs)
    names = [c for c in docs.columns if c != "text"]
    df = docs.select(*names, as_bytes("text").alias("_b_text"))
    fields = {"n": "bigint", "terms": "array<binary>", "tfs": "array<int>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), *(f"{k} {v}" for k, v in fields.items())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = _Passed(None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8)))
        for batch in batches:
            for part, texts in text_slices(batch, "_b_text"):
                n, terms, tfs, first = [], [], [], [0]
                for text in texts:
                    words = terms_of(text)
                    count = Counter(filter(None, map(passed.__getitem__, words)))
                    n.append(len(words))
                    terms.extend(count)
                    tfs.extend(count.values())
                    first.append(len(terms))
                off = pa.array(first, pa.int32())
                cols = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(off, pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *cols], names=[*names, *fields])

    return df.mapInArrow(emit, schema)


def vocabulary_bitmap(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, set at the hashes of the distinct values of ``terms._term``."""
    places = terms.select((F.crc32(TERM) % FILTER_BITS).cast("int").alias("p")).distinct().toPandas()["p"]   # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[places.to_numpy(dtype=np.int64)] = True
    return np.packbits(bits).tobytes()


def _pack(values) -> bytes:
    raw = np.ascontiguousarray(values, dtype="<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True), dtype="<i4")


def _blocks(members: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of one posting list by block, and the blocks' sizes."""
    count = -(-len(members) // BLOCK)
    if count == 1:
        return members, np.array([len(members)])
    centres = sketch[members[np.arange(count) * len(members) // count]]
    nearest = np.argmax(sketch[members] @ centres.T, axis=1)
    sizes = np.bincount(nearest, minlength=count)
    return members[np.argsort(nearest, kind="stable")], sizes[sizes > 0]


def build_shard(doc_ids: list, sizes: np.ndarray, terms: list[bytes], impact: np.ndarray) -> dict:
    """One row of the index (see ``_INDEX``) for documents with ``sizes`` terms each."""
    names = sorted(set(terms))
    number = {t: k for k, t in enumerate(names)}
    term = np.fromiter(map(number.__getitem__, terms), dtype=np.int64, count=len(terms))
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    width = len(names)
    by_term = np.argsort(term, kind="stable")
    listed = np.bincount(term, minlength=width)
    list_first = np.concatenate([[0], np.cumsum(listed)])
    axes = np.random.default_rng(SKETCH).standard_normal((width, SKETCH), dtype=np.float32)
    sketch = np.zeros((len(sizes), SKETCH), dtype=np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        rare = np.log1p(len(sizes) / np.maximum(listed, 1)).astype(np.float32)
        sketch[full] = np.add.reduceat(axes[term] * (impact.astype(np.float32) * rare[term])[:, None], first[full])
        sketch[full] /= np.maximum(np.linalg.norm(sketch[full], axis=1, keepdims=True), 1e-20)
    block_term, block_sizes, members, places, tops = [], [], [], [], []
    blocks = 0
    for t in range(width):
        docs, parts = _blocks(owner[by_term[list_first[t]:list_first[t + 1]]], sketch)
        entries = ranges(first[docs], sizes[docs])
        cell = term[entries]
        if len(parts) > 1:
            ends = np.cumsum(sizes[docs])[np.cumsum(parts) - 1].tolist()
            for b, (x, y) in enumerate(zip(ends, ends[1:]), 1):
                cell[x:y] += b * width
        most = np.zeros(len(parts) * width, dtype=np.int32)
        np.maximum.at(most, cell, impact[entries])
        there = np.flatnonzero(most)
        places.append((there % width) * (1 << 32) + blocks + there // width)
        tops.append(most[there])
        block_term.append(np.full(len(parts), t, dtype=np.int32))
        block_sizes.append(parts)
        members.append(docs)
        blocks += len(parts)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    place, top = join(places), join(tops)
    order = np.argsort(place)                                         # by term, then block
    place = place[order]
    summary_first = np.searchsorted(place >> 32, np.arange(width + 1))
    numbers = (first, term, impact, join(block_term), np.concatenate([[0], np.cumsum(join(block_sizes))]), join(members),
               summary_first, place & 0xFFFFFFFF, top[order])
    return {"doc_ids": doc_ids, "vocabulary": names, "documents": listed.tolist()} | {c: _pack(x) for c, x in zip(_PACKED, numbers, strict=True)}


def build_index(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Index rows, one a shard, of ``term_counts`` rows (doc_id, n, terms, tfs), given how
    many documents have a term and how many terms they have."""
    prepare(counts)
    df = counts.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs").where("size(terms) > 0")
    kinds = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([*((c, kinds[t]) for c, t in _LISTS.items()), *((c, pa.binary()) for c in _PACKED)])

    def row(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        flat = lambda name: t.column(name).combine_chunks().flatten()
        sizes = np.asarray(pa.compute.list_value_length(t.column("terms")), dtype=np.int64)
        tf = np.asarray(flat("tfs"), dtype=np.int64)
        m = 25 + (75 * np.asarray(t.column("n"), dtype=np.int64) * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
        shard = build_shard(t.column("doc_id").to_pylist(), sizes, flat("terms").to_pylist(), impact.astype(np.int32))
        return pa.RecordBatch.from_pylist([shard], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, postings = [], 0, 0
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(2)), dtype=np.int64))
            a = 0
            while a < batch.num_rows:
                before = int(ends[a - 1]) if a else 0
                b = int(np.searchsorted(ends, before + SHARD_POSTINGS - postings, side="right"))
                b = min(batch.num_rows, a + SHARD_DOCUMENTS - docs, max(b, a if part else a + 1))
                if b > a:
                    part.append(batch.slice(a, b - a))
                    docs, postings = docs + b - a, postings + int(ends[b - 1]) - before
                a = b
                if a < batch.num_rows:
                    yield row(part)
                    part, docs, postings = [], 0, 0
        if part:
            yield row(part)

    return df.mapInArrow(emit, _INDEX)


class Shard:
    """An index row, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids, self.number = row["doc_ids"], {t: k for k, t in enumerate(row["vocabulary"])}
        (self.first, self.term, self.impact, block_term, self.member_first, self.members,
         self.summary_first, self.summary_block, self.summary_max) = (_unpack(row[c]) for c in _PACKED)
        self.blocks = len(self.member_first) - 1
        self.list_blocks = np.searchsorted(block_term, np.arange(len(self.number) + 1))
        self.weight = np.zeros(len(self.number), dtype=np.int64)
        self.opened = 0                                                                # documents scored
        self.top = np.maximum.reduceat(self.summary_max, self.summary_first[:-1])     # every term has a block

    def search(self, query: list[tuple[bytes, int]], best: list[tuple], k: int) -> list[tuple]:
        """The k best (-score, no doc_id, doc_id) of ``best`` and this shard."""
        own = [(self.number[t], w) for t, w in query if t in self.number and w > 0]
        if not own:
            return best
        bound = np.zeros(self.blocks, dtype=np.int64)
        for t, w in own:
            s = slice(self.summary_first[t], self.summary_first[t + 1])
            bound[self.summary_block[s]] += np.int64(w) * self.summary_max[s]
            self.weight[t] = w
        lists, weights = (np.array(x) for x in zip(*own))
        worth = weights.astype(np.int64) * self.top[lists]
        order = np.argsort(worth, kind="stable")
        lists, reach = lists[order], np.cumsum(worth[order])      # reach: the most that a list and those worth less give together
        size = self.list_blocks[lists + 1] - self.list_blocks[lists]
        block, reach = ranges(self.list_blocks[lists], size), np.repeat(reach, size)
        order = np.argsort(-bound[block], kind="stable")
        block, reach = block[order], reach[order]
        bound = bound[block]
        seen = np.zeros(len(self.doc_ids), dtype=bool)
        at, want = 0, FIRST_DOCUMENTS
        while at < len(block):
            least = -best[-1][0] if len(best) >= k else 1
            stop = int(np.searchsorted(-bound, -least, side="right"))      # bounds below it can't win, equal ones may
            size = np.cumsum(self.member_first[block[at:stop] + 1] - self.member_first[block[at:stop]])
            end = min(stop, at + 1 + int(np.searchsorted(size, want)))
            if end <= at:
                break
            # a document that is in no list from here on but in ones of too little reach can't win either
            use = block[at:end][reach[at:end] >= least]
            docs = self.members[ranges(self.member_first[use], self.member_first[use + 1] - self.member_first[use])]
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            if len(docs):
                best = self._scored(docs, best, k)
            at, want = end, 2 * want
        self.opened += int(seen.sum())
        self.weight[lists] = 0
        return best

    def _scored(self, docs: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        size = self.first[docs + 1] - self.first[docs]
        entry = ranges(self.first[docs], size)
        score = np.add.reduceat(self.weight[self.term[entry]] * self.impact[entry], np.cumsum(size) - size)
        least = -best[-1][0] if len(best) >= k else 1
        win = np.flatnonzero(score >= max(least, 1))
        if len(win) > 4 * k:                       # all that reach the k-th largest of these, ties too
            win = win[score[win] >= np.partition(score[win], len(win) - k)[len(win) - k]]
        ids = [self.doc_ids[d] for d in docs[win].tolist()]
        return sorted([*best, *((-s, d is None, d or 0) for s, d in zip(score[win].tolist(), ids))])[:k]


def search_index(index: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], k: int = TOP) -> DataFrame:
    """(query, doc_id, score): every task's k best for each of a bounded block of queries
    (number, [(term, weight)])."""
    spark = prepare(index)
    sent = spark.sparkContext.broadcast(queries)
    schema = pa.schema([(QUERY, pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {q: [] for q, _ in sent.value}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)})
                for q, terms in sent.value:
                    best[q] = shard.search(terms, best[q], k)
        rows = [(q, None if no else d, -s) for q, found in best.items() for s, no, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

    return index.mapInArrow(emit, f"{QUERY} long, doc_id long, score long")


def term_weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def _query_blocks(spark: SparkSession, weighted: DataFrame) -> Iterator[list[tuple[int, list[tuple[bytes, int]]]]]:
    """The queries with their terms, about QUERY_TERMS terms at a time."""
    rows = weighted.groupBy(QUERY).agg(F.collect_list(F.struct(TERM, "w")).alias("terms"))
    count = max(1, math.ceil(weighted.count() / QUERY_TERMS))
    for b in range(count):
        part = rows.where(F.pmod(F.xxhash64(QUERY), F.lit(count)) == b).collect()
        if part:
            yield [(r[QUERY], [(bytes(t[TERM]), t["w"]) for t in r["terms"]]) for r in sorted(part, key=lambda r: r[QUERY])]


def rank_documents(docs: DataFrame, queries: DataFrame, query_id: str, k: int = TOP) -> DataFrame:
    """For every row of ``queries`` (``query_id``, text) its k best documents of ``docs``
    (doc_id, text): query_id, rank, doc_id, score."""
    spark = prepare(docs)
    asked = stored(queries.select(F.col(f"`{query_id}`").alias("_id"), "text").distinct().withColumn(QUERY, F.monotonically_increasing_id()), "queries")
    wanted = stored(term_counts(asked.select(QUERY, "text")).select(QUERY, F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
                    .select(QUERY, F.col("t.terms").alias(TERM), F.col("t.tfs").alias("times")), "query-terms")
    bitmap = spark.sparkContext.broadcast(vocabulary_bitmap(wanted))
    counts = stored(term_counts(docs.select("doc_id", "text"), bitmap), "terms")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    index = stored(build_index(counts, total.docs, total.terms), "index", rows_per_file=ROWS_PER_FILE)
    discard(counts)
    listed = index.select(F.explode(F.arrays_zip("vocabulary", "documents")).alias("t")).groupBy(F.col("t.vocabulary").alias(TERM)).agg(F.sum("t.documents").alias("df"))
    weighted = stored(wanted.join(listed, TERM).select(QUERY, TERM, (F.col("times") * term_weight(total.docs, F.col("df"))).alias("w")).where("w > 0"), "weights")
    found = None
    for block in _query_blocks(spark, weighted):
        part = search_index(index, block, k)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], f"{QUERY} long, doc_id long, score long")
    order = Window.partitionBy(QUERY).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn(RANK, F.row_number().over(order)).where(F.col(RANK) <= k)
    return asked.join(ranked, QUERY).select(F.col("_id").alias(query_id), RANK, "doc_id", "score")
