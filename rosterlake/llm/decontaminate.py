"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton whose states stand for
the word sequences that occur in some item. Training text streams through it
while the longest match ending at each word is tracked; a match of ``width``
words or more means that a benchmark window ends there. Each state knows the
items that hold its window, so items are named without a second look.

The automaton is sent to every task, so its size is bounded: items are dealt by
hash into automata of about ``MAX_AUTOMATON_WORDS`` words, and the documents pass
through one after the other in the same stage (no shuffle at any size).

Defined results: null or blank text has no words and is clean; items without text or
words match nothing; equal items are each named; an item with a null item_id marks
its words like any other and is listed as a null, last, once however many there are; an
empty benchmark leaves every document clean. Extra columns of the documents pass through; one with the name of
a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare, shielded, text_slices

WIDTH = 10                    # fixed value (contract): words of a window
MAX_AUTOMATON_WORDS = 100_000
MAX_COVERAGE = 0.5            # a document with a larger share of hit words goes whole

# A-Z to lower case; everything that is no letter, digit or non-ASCII byte splits words.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32)
                    for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with window owners by state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, seq in kept:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._owners(kept)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:                       # an earlier item has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _owners(self, kept: list[tuple[str, list[int]]]) -> None:
        w, link, length = self.width, self.link, self.length
        order = sorted(range(1, len(link)), key=length.__getitem__)
        # window[v]: the state of the last ``w`` words of v's strings
        window = [0] * len(link)
        for v in order:
            window[v] = v if length[v] >= w > length[link[v]] else window[link[v]]
        owners: dict[int, set[str | None]] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        for name, seq in kept:
            v = 0
            for j, c in enumerate(seq):
                v = self.next[v][c]
                if j + 1 >= w:
                    owners.setdefault(window[v], set()).add(name)
            if len(seq) < w:
                short.setdefault(v, []).append((len(seq), name))
        self.window, self.owners = window, owners
        # shorter items that end where a match ends, through the suffix links
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * len(link)
        for v in order:
            own = short.get(v)
            self.short[v] = self.short[link[v]] + tuple(own) if own else self.short[link[v]]
        self.has_short = bool(short)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(hit word ranges [a, b) merged and in order, names of the items hit)."""
        nxt, link, length, window, owners, w = self.next, self.link, self.length, self.window, self.owners, self.width
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        v = n = 0
        vocab, short, has_short = self.vocab, self.short, self.has_short
        for j, word in enumerate(words):
            c = vocab.get(word, -1)
            if c < 0:
                v = n = 0
                continue
            t = nxt[v].get(c)
            if t is None:
                while v != -1 and c not in nxt[v]:
                    v = link[v]
                if v == -1:
                    v = n = 0
                    continue
                n = length[v]
                t = nxt[v][c]
            v = t
            n += 1
            if n >= w:
                names |= owners[window[v]]
                _add(spans, j + 1 - w, j + 1)
            if has_short and short[v]:
                for m, name in short[v]:
                    if m <= n:
                        names.add(name)
                        _add(spans, j + 1 - m, j + 1)
        return spans, names


def _add(spans: list[tuple[int, int]], a: int, b: int) -> None:
    while spans and spans[-1][1] >= a:
        a = min(a, spans.pop()[0])
    spans.append((a, b))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_shards(benchmark: DataFrame, max_words: int) -> Iterator[tuple[bool, list[tuple[str | None, list[bytes]]]]]:
    """(is it the last, items) of hash shards, each collected by itself and of bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), as_bytes("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // (4 * max_words)))   # four bytes a word and over
    for k in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        rows = part.collect()  # bounded: about 4 * max_words bytes of benchmark text
        yield k + 1 == shards, [(r["item"], normal_words(bytes(r["text"]))) for r in rows]


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, max_words: int,
             finish: Callable[[pa.RecordBatch, list, list, list], pa.RecordBatch] | None = None, kinds: str = "") -> DataFrame:
    """``docs``, whose last column _d_text is the text in bytes, plus n_words, hit_spans and
    items; or what ``finish`` makes of (rows, texts, n_words, spans) in the last pass, with
    the columns ``kinds``. Work done there needs no Python worker of its own."""
    spark = prepare(docs)
    base = [f.name for f in docs.schema.fields]
    df = docs.select("*", F.lit(0).cast("long").alias("n_words"),
                     F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("hit_spans"),
                     F.expr("cast(array() as array<string>)").alias("items"))
    schema = df.schema
    span_type, item_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())
    for last, rows in _item_shards(benchmark, max_words):
        sent = spark.sparkContext.broadcast((rows, width))
        own = finish if last else None

        def emit(batches: Iterator[pa.RecordBatch], sent=sent, own=own) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(*sent.value)
            for batch in batches:
                for part, texts in text_slices(batch, "_d_text"):
                    at = part.schema.get_field_index
                    n_words, spans, items = [], [], []
                    for text, s0, i0 in zip(texts, part.column(at("hit_spans")).to_pylist(),
                                            part.column(at("items")).to_pylist(), strict=True):
                        words = normal_words(text)
                        s, names = automaton.scan(words)
                        if s0:
                            s = merge_spans(s + [(x["a"], x["b"]) for x in s0])
                        n_words.append(len(words))
                        spans.append(s)
                        items.append(sorted(names.union(i0), key=lambda x: (x is None, x or "")))
                    if own:
                        yield own(part, texts, n_words, spans)
                        continue
                    cols = [part.column(k) for k in range(len(base))]
                    cols += [pa.array(n_words, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], span_type),
                             pa.array(items, item_type)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*base, "n_words", "hit_spans", "items"])

        df = df.mapInArrow(emit, kinds if own else schema)
    return df


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                       max_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """``docs`` plus n_words, hit_spans (array of word ranges [a, b)) and items (sorted, a
    null last)."""
    docs = docs.drop("n_words", "hit_spans", "items", "n_hit", "n_items")   # the results take these names
    df = _scanned(docs.select("*", F.col("text").cast("binary").alias("_d_text")), benchmark, width, max_words)
    return df.drop("_d_text").withColumns({
        "n_hit": F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x.b - x.a)"),
        "n_items": F.size("items").cast("long"),
    })


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                         max_coverage: float = MAX_COVERAGE, max_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """Cut every hit span out of the text; documents whose hit share exceeds
    ``max_coverage`` go whole. Clean documents stay byte for byte. The pass that finds the
    last spans cuts them: a second Python stage would hold two more workers in each executor."""
    docs, restore = shielded(docs, "text")
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")

    def cut(part: pa.RecordBatch, texts: list, n_words: list, spans: list) -> pa.RecordBatch:
        keep = pa.array([sum(b - a for a, b in s) <= n * max_coverage for s, n in zip(spans, n_words, strict=True)], pa.bool_())
        cols = [part.column(k) for k in range(len(names) - 1)]
        cols.insert(at, pa.array([cut_words(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.select(*(n for n in names if n != "text"), F.col("text").cast("binary").alias("_d_text"))
    out = _scanned(rows, benchmark, width, max_words, cut, kinds)
    return out.withColumn("text", F.col("text").cast("string")).transform(restore)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    import re

    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_WORD_BYTES))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:places[a][0]])
        last = places[b - 1][1]
    out.append(text[last:])
    return b"".join(out)
