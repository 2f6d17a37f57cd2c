"""Piece encoding, ranked search and periodic runs against the library, brute force and
hand-made cases: nulls, empty and long texts, repeated rows, ties, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rosterlake.llm import lexical_search, periodic_runs, piece_bpe, queries

from test_operators import corpus

SMALL = "/root/testdata/sf0.001"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- op11 -----------------------------------------------------------------------------

ODD = [None, "", " ", "  ", "   a  b   ", "\n", "\n\n a", "a\n", "▁", "▁▁x", "a▁b", "é中\x00b", "\U0001F600 x", "<s> </s> <unk> <0x0A>", "ab" * 5000,
       " " * 40 + "x", " " * 300, "x\ty", "\r\n", "aaaaaaa aaaaaaaa", "a \n b", "long " * 20_000, "xyz " * 50 + "q" * 700]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceBpe(piece_bpe.prepared(piece_bpe.read_model(queries.tokenizer_path("piece_bpe_32k.model"))))


def test_pieces_equal_the_library(library, coder):
    rnd = random.Random(3)
    own = list(coder.score)
    texts = [t for t in ODD if t is not None]
    for _ in range(1500):
        texts.append("".join(rnd.choice([rnd.choice(own).replace("▁", " "), rnd.choice("abcdeinorst  "), rnd.choice(["\n", " ", "é", "中", "\x01", "▁"])])
                             for _ in range(rnd.randrange(1, 30))))
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(coder.encode(text), "<u4")
        assert got.tolist() == want, text[:80]
        assert coder.decode(got).decode() == library.decode(want)


def test_pairs_are_compatible_exactly_if_their_merge_leaves_them(coder):
    rnd = random.Random(4)
    reach = [i for i in range(len(coder.pieces)) if coder.pieces[i] in coder.score]
    short = [i for i in reach if coder.length[i] <= 3]
    for _ in range(4000):
        a, b = rnd.choice(reach if rnd.random() < .5 else short), rnd.choice(short)
        both = coder.pieces[a] + coder.pieces[b]
        assert coder.compatible(a, b) == (piece_bpe.merge(list(both), coder.score) == [coder.pieces[a], coder.pieces[b]])


def test_any_ids_decode_like_the_library(library, coder):
    rnd = random.Random(5)
    for _ in range(600):
        ids = [rnd.randrange(3, 259) if rnd.random() < .6 else rnd.randrange(0, 32000) for _ in range(rnd.randrange(0, 12))]
        assert coder.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids)


def test_piece_columns(spark, library):
    rows = [(k, t, "clash", 7) for k, t in enumerate(ODD + ODD[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int").repartition(3)
    path = queries.tokenizer_path("piece_bpe_32k.model")
    want = {k: library.encode(t or "", add_bos=True, add_eos=True) for k, t, *_ in rows}
    full = piece_bpe.encode_documents(docs, path)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in full.collect():
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(want[r.doc_id]) and r.n_tokens == 7
    for r in piece_bpe.encode_digests(docs, path).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))
    none = docs.limit(0)
    assert piece_bpe.encode_documents(none, path).count() == piece_bpe.encode_digests(none, path).count() == 0


# --- op12 -----------------------------------------------------------------------------

def ranked(docs: list[tuple], items: list[tuple], k: int = 10) -> dict:
    """(item_id, text) -> [(rank, doc_id, score)] by the contract, one document after another."""
    import math
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, words(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(x for _, w in bags for x in set(w))
    weight = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for x, c in df.items()}
    out = {}
    for item, text in dict.fromkeys(items):
        rows = []
        for d, w in bags:
            tf = Counter(w)
            m = 25 + (75 * len(w) * n_docs) // max(n_terms, 1)
            s = sum(weight[x] * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in words(text) if x in tf)
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out[item, text] = [(i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(rows)[:k])]
    return out


@pytest.mark.parametrize("shard, block", [(8192, 128), (7, 2), (40, 3)])
def test_ranking_against_brute_force(spark, monkeypatch, shard, block):
    docs = [(d, t) for d, t, *_ in corpus(seed=11, n=70)]
    docs += [(None, docs[20][1]), (docs[30][0], docs[20][1]), docs[40], docs[40], (9001, "Only CAPS caps w1"), (9002, "only caps caps w1")]
    docs += [(9100 + k, "tie w5 w6") for k in range(14)]
    rnd = random.Random(12)
    items = [(k, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 25)))) for k in range(25)]
    items += [(50, None), (51, ""), (52, "no-such-term 123456"), (53, "tie tie W5"), (53, "tie tie W5"), (53, "CAPS"), (None, "w7 w8 w9"), (54, docs[25][1])]
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 100)
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    # the tasks run in other processes: sizes go with the arrays, not with the module
    counts = [(d, Counter(lexical_search.terms_of((t or "").encode())), len(lexical_search.terms_of((t or "").encode()))) for d, t in docs]
    want = ranked(docs, items)
    got = {}
    for r in lexical_search.rank_documents(left, right, "item_id").collect():
        got.setdefault((r.item_id, r.score, r.doc_id), []).append(r["rank"])
    flat = {}
    for (item, _), rows in want.items():
        for rank, d, s in rows:
            flat.setdefault((item, s, d), []).append(rank)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in flat.items()}
    # the same by hand over shards of given sizes
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "FIRST_DOCUMENTS", 3)
    assert by_hand(counts, items, shard) == {q: [(-s, d) for _, d, s in rows] for q, rows in want.items()}


def by_hand(counts, items, shard: int) -> dict:
    import math

    n_docs, n_terms = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    rows = [(d, c, n) for d, c, n in counts if c]
    best = {q: [] for q in items}
    opened = 0
    for a in range(0, len(rows), shard):
        part = rows[a:a + shard]
        impact = [(10**9 * f) // (1000 * f + 8 * (25 + 75 * n * n_docs // n_terms)) for _, c, n in part for f in c.values()]
        built = lexical_search.build_shard([d for d, *_ in part], np.array([len(c) for _, c, _ in part]), [t for _, c, _ in part for t in c], np.array(impact, np.int32))
        s = lexical_search.Shard(built)
        assert s.member_first[-1] == len(impact)            # every posting lies in one block of its list
        for q in best:
            terms = Counter(lexical_search.terms_of((q[1] or "").encode()))
            query = [(t, c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t, c in terms.items() if t in df]
            best[q] = s.search(query, best[q], 10)
        opened += s.opened
    return {q: [(s, None if no else d) for s, no, d in rows] for q, rows in best.items()}


def test_summaries_bound_every_document_of_their_block():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 30, 300)
    terms = [b"%d" % t for n in sizes for t in rnd.choice(60, n, replace=False)]
    impact = rnd.integers(1, 10**6, len(terms)).astype(np.int32)
    row = lexical_search.build_shard(list(range(300)), sizes, terms, impact)
    built = row | {c: lexical_search._unpack(row[c]) for c in lexical_search._PACKED}
    first, blocks = built["first"], len(built["member_first"]) - 1
    top = np.zeros((blocks, len(built["vocabulary"])), dtype=np.int64)
    col = np.repeat(np.arange(len(built["vocabulary"])), np.diff(built["summary_first"]))
    top[built["summary_block"], col] = built["summary_max"]
    for b in range(blocks):
        full = np.zeros((0, top.shape[1]))
        for d in built["members"][built["member_first"][b]:built["member_first"][b + 1]]:
            row = np.zeros(top.shape[1], dtype=np.int64)
            row[built["term"][first[d]:first[d + 1]]] = impact[first[d]:first[d + 1]]
            full = np.vstack([full, row])
        assert (full.max(axis=0) == top[b]).all()


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical_search.rank_documents(docs.limit(0), items, "item_id").count() == 0
    out = lexical_search.rank_documents(docs, items.limit(0), "item_id")
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert lexical_search.rank_documents(nulls, items, "item_id").count() == 0


# --- op13 -----------------------------------------------------------------------------

def brute_runs(w: list) -> list[tuple[int, int, int]]:
    out: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def fold(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


@pytest.mark.parametrize("max_pairs", [5, 1 << 19])
def test_runs_against_brute_force(monkeypatch, max_pairs):
    monkeypatch.setattr(periodic_runs, "MAX_PAIRS", max_pairs)
    rnd = random.Random(6)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randrange(1, 8)):
            k = rnd.choice([1, 2, 3, 30])
            docs.append(fold(rnd.randrange(1000), [rnd.randrange(k) for _ in range(rnd.choice([0, 1, 5, 6, 20, 60, 200]))]))
        flat, sizes = np.array([x for w in docs for x in w], dtype=np.int64), np.array([len(w) for w in docs], dtype=np.int64)
        got = [[] for _ in docs]
        for d, *run in zip(*(x.tolist() for x in periodic_runs.find_runs(flat, sizes))):
            got[d].append(tuple(run))
        assert got == [brute_runs(w) for w in docs]


def test_extensions_against_brute_force():
    rnd = np.random.default_rng(7)
    for k in (1, 2, 5, 400):
        w = np.append(rnd.integers(0, k, 300), k)
        w[100:200] = w[:100]
        lce = periodic_runs.Lce(w)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
        i, j = i[i < j], j[i < j]
        want = [next((n for n in range(300) if w[a + n] != w[b + n])) for a, b in zip(i.tolist(), j.tolist())]
        assert lce(i, j).tolist() == want


def digests(doc_id, text) -> tuple:
    w = fold(doc_id, (text or "").encode().split())
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_query_against_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in corpus(seed=8)]
    rows += [(10_000 + k, t) for k, t in enumerate([None, "", " \t\n", "a a a a a a", "a a a a a", "ab cd " * 4 + "x", "x y z " * 900 + "end", "é \xa0 " * 12])]
    rows += [rows[5], rows[5], (rows[5][0], rows[6][1]), (None, "b c " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((digests(*r) for r in rows), key=key)


def test_run_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", "own", 5)], "doc_id long, text string, start string, other int")
    out = periodic_runs.detect_runs(docs)
    assert out.columns == ["doc_id", "text", "other", "n_words", "n_runs", "start", "length", "period", "runs", "kept_text"]
    r = out.first()
    assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.kept_text, r.other) == (9, 1, 0, 8, 2, "a b c", 5)
    assert periodic_runs.detect_runs(docs.limit(0)).count() == 0


# --- queries --------------------------------------------------------------------------

def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_lexical_search"]).fetchall()
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op12_lexical_search(spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and want
