"""The training-data operators against brute force on small tables with nulls,
empty and long texts, repeated rows, odd columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rosterlake.llm import (bpe, components, decontaminate, html_extract, induced_sort, jaccard_join, language_id,
                            line_dedup, quality_rules, queries, substring_dedup, suffix_dedup)
from rosterlake.llm.common import WindowHash, word_hashes

SMALL = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, n_words string, lang string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared lines and passages, and edge cases."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    prose = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passage, line = " ".join(prose(60)), "A Line that Many documents share, " + " ".join(prose(5))
    texts: list[str | None] = [None, "", " \n\t ", "one", "a b c d", "a b c d", "é ü 中 " * 40, "x " * 3000, "ab" * 400]
    for k in range(n):
        words = prose(rnd.randrange(30, 120))
        if k % 5 == 0:
            words[10:10] = passage.split()
        text = " ".join(words)
        if k % 4 == 0:
            text = f"{text}\n  {line.upper() if k % 8 else line} \n{' '.join(prose(30))}\n"
        texts.append(text)
        if k % 6 == 0:
            texts.append(text)
        if k % 7 == 0:
            w = text.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    return [(3 * i, t, "clash", "xx") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KINDS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_word_windows_against_brute_force(docs, empty):
    first, late = {}, defaultdict(set)
    for d, t, *_ in corpus():
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i:i + 20]), (d, i)) != (d, i):
                late[d].update(range(i, i + 20))
    # small chunks, blocks and a narrow sketch: many chunks, false alarms, several blocks
    got = substring_dedup.dedup_substrings(docs, chunk_bytes=4000, cells_per_anchor=1).collect()
    assert len(got) == docs.count()
    for r in got:
        w = (dict((d, t) for d, t, *_ in corpus())[r.doc_id] or "").split()
        assert (r.n_words, r.n_removed) == (len(w), len(late[r.doc_id]))
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in late[r.doc_id])
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("chunk_bytes", [600, 1 << 20])
def test_word_windows_of_rows_that_share_a_doc_id(spark, chunk_bytes):
    import random
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage, other = words(30), words(25)
    rows = [(1, passage + words(5)), (1, words(4) + passage + words(9)), (2, other), (3, other), (3, words(600) + other + words(3) + passage),
            (3, words(30)), (4, words(400) + passage + words(5) + passage + other), (4, passage), (4, passage), (5, words(50)), (None, passage), (0, words(3) + other + other)]
    rows = [(d, " ".join(w)) for d, w in rows]
    seen = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        for i in range(len(t.split()) - 19 if d is not None else 0):
            seen[tuple(t.split()[i:i + 20])].append((d, k, i))
    late = defaultdict(set)
    for places in seen.values():
        for d, k, i in places:
            if any(e < d or (m == k and j < i) for e, m, j in places):
                late[k].update(range(i, i + 20))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = [(d, len(w), len(late[k]), " ".join(x for i, x in enumerate(w) if i not in late[k])) for k, (d, t) in enumerate(rows) for w in [t.split()]]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and sum(map(len, late.values())) > 100


def test_byte_strings_against_brute_force(docs, empty):
    rows, seen = corpus(), defaultdict(list)
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            seen[b[i:i + 200]].append((d, i))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 200))
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(docs, chunk_bytes=5000, shard_bytes=8000).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        b, g = (t or "").encode(), gone[d]
        spans = sum(1 for i in g if i - 1 not in g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(g), spans)
        assert bytes(r.kept) == bytes(x for i, x in enumerate(b) if i not in g)
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_passage_in_very_many_documents(spark):
    """A passage in different surroundings: its shards are beyond what a task may hold."""
    import random
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(450)
    rows = [(d, noise(rng.randint(50, 300)) + passage + noise(rng.randint(50, 300))) for d in range(80)] + [(d, noise(400)) for d in range(80, 100)]
    rows += [(100, rows[3][1]), (101, rows[3][1][40:] + noise(60)), (102, None)]
    seen, gone = defaultdict(list), defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - 199):
            seen[t[i:i + 200]].append((d, i))
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 200))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(df, chunk_bytes=5000, shard_bytes=8000, hot_bytes=8000).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {d: len(gone[d]) for d, _ in rows}
    assert all(bytes(got[d].kept) == bytes(x for i, x in enumerate((t or "").encode()) if i not in gone[d]) for d, t in rows)
    parts = spark.createDataFrame([(d % 3 if d < 50 else 7, d % 4, d, 0, False, bytearray(t.encode()[:240])) for d, t in rows[:80]],
                                  "shard long, chunk int, rid long, start int, known boolean, data binary")
    cold, hot = suffix_dedup.split_hot(parts, 5000)
    assert {r.shard for r in hot.select("shard").distinct().collect()} == {7} and cold.count() == 50


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_induced_sort(monkeypatch, limit):
    monkeypatch.setattr(induced_sort.BucketQueues.__init__, "__defaults__", (limit,))
    monkeypatch.setattr(induced_sort, "MAX_ALPHABET", 8)
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 40, 300):
        for sigma in (1, 2, 4):
            t = np.array([rnd.randrange(sigma) for _ in range(n)])
            assert induced_sort.sort_suffixes(t, 10 ** 6).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_bpe_is_the_library(spark, empty):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(bpe.load_spec(path))
    rnd = random.Random(3)
    texts = [t or "" for _, t, *_ in corpus()] + [
        "<|endoftext|> Hi<|startoftext|>x", "ΑΣ Σ", "a" * 3000, "İstanbul ẞ ǅ it's I'LL", "١٢ ½ 🎉日本", "x y　z\x1cq",
        "".join(rnd.choice("abcdefghij") for _ in range(5000))]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x370, 0xd800)])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(np.array(ids, dtype=np.int32)).decode() == library.decode(ids, skip_special_tokens=False)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    for r in bpe.encode_digests(rows, path).collect():
        ids = library.encode(texts[r.doc_id] if r.doc_id is not None else "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
    assert bpe.encode_documents(empty, path).count() == 0


def test_decontamination_against_brute_force(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    rows = corpus()
    long = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [("i1", " ".join(long[0].split()[5:30])), ("i2", " ".join(long[1].split()[3:7])), ("i3", None), ("i4", "- !"),
             ("i5", " ".join(long[0].split()[5:30]).upper()), ("i6", "w1"), (None, "w2"), ("i7", "never seen " * 8)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {}
    for d, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for name, x in items:
            v = words(x)
            m = min(10, len(v))
            if not m:
                continue
            windows = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)}
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    names.add(name)
        want[d] = (len(w), len(hit), sorted(names, key=lambda x: (x is None, x or "")))
    for shards in (100_000, 20):        # one automaton, several
        got = decontaminate.find_contamination(docs, bench, max_words=shards).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == want
        assert all(r.n_items == len(r.items) for r in got) and any(None in r.items for r in got)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    clean = {d for d, v in want.items() if not v[1]}
    left = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert all(left[d] == t for d, t, *_ in rows if d in clean)
    assert all(v[1] <= 0.5 * v[0] for d, v in want.items() if d in left)


def test_contamination_is_cut_in_the_pass_that_finds_it(spark):
    """One Python stage, so two workers less in each executor; the same cut in one pass or several."""
    from rosterlake.plans.checks import physical_plan

    item = " ".join(f"bench{k}" for k in range(12))
    docs = spark.createDataFrame([
        (1, f"Words before {item.upper()}, words after it and more of them, so that most of it stays here.", 7, "own"),
        (2, item, 8, "own"), (3, "clean  text\n\ttiny thing", 9, None), (4, None, 1, "own"), (None, "a tiny item of many words", None, "own"),
        (6, "", 2, None)], "doc_id long, text string, n_words int, `items` string")
    bench = spark.createDataFrame([("i1", item), ("i2", "tiny item"), ("i3", None), (None, "far words")], "item_id string, text string")
    want = [(None, "a  of many words", None, "own"), (1, "Words before , words after it and more of them, so that most of it stays here.", 7, "own"),
            (3, "clean  text\n\ttiny thing", 9, None), (4, None, 1, "own"), (6, "", 2, None)]
    for width, words, passes in ((10, 100_000, 1), (10, 10, 3)):
        out = decontaminate.remove_contamination(docs, bench, width, max_words=words)
        assert out.schema == docs.schema and physical_plan(out).count("MapInArrow") == passes
        assert sorted(map(tuple, out.collect()), key=lambda r: r[0] or 0) == want


def test_jaccard_components_against_brute_force(docs, empty):
    rows = corpus()
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_shingle_sets_of_many_texts_equal_sets_text_by_text():
    rnd = random.Random(5)
    words = ["a", "B", "é", "x" * 8, "x" * 9, "y" * 64, "y" * 65, "Z" * 200, "ab\x00", "ab", "\x1c"]
    texts = [None, b"", b" \t\n\x0b\x0c\r ", *("".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t "]) for _ in range(rnd.randrange(0, 40))).encode() for _ in range(300))]
    split = [(t or b"").lower().split() for t in texts]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(w) for w in split]
    every = [w for s in split for w in s]
    assert len(set(zip(every, hashes.tolist()))) == len(set(every)) == len(set(hashes.tolist()))
    hasher = WindowHash(jaccard_join.BASE)
    sets = jaccard_join.word_sets(texts, 5, hasher)
    got = [s.tolist() for s in sets.each()]
    alone = [jaccard_join.word_sets([t], 5, hasher).keys.tolist() for t in texts]
    want = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in split]
    assert got == alone and [len(g) for g in got] == [len(w) for w in want] and all(g == sorted(set(g)) for g in got)
    assert len({k for g in got for k in g}) == len(set().union(*want))
    common = np.unique(sets.keys)[::3]
    classes = np.arange(len(common)) % 14 + 1
    rank = dict(zip(common.tolist(), classes.tolist()))
    keys = jaccard_join.Order(common, classes).keys(sets)
    assert [k.tolist() for k in keys.each()] == [sorted(h | rank.get(h, 0) << 57 for h in g) for g in got]
    cuts = [(k + 1) << 55 for k in range(4)] + [(1 + 4 * k) << 57 for k in (1, 2, 3)]
    assert jaccard_join.fragments_of(keys, 4).to_pylist() == [[p.tolist() for p in np.split(k, np.searchsorted(k, cuts))] for k in keys.each()]
    assert jaccard_join.Order(common[:0], classes[:0]).keys(sets).keys.tolist() == sets.keys.tolist()
    assert jaccard_join.word_sets([], 5, hasher).keys.tolist() == []


def test_components_of_a_path(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_line_dedup_against_brute_force(docs, empty):
    rows = corpus()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and d != max(holders[key(x)]))]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_text or "") == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert got[d].lang == "xx"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_levels(spark, docs):
    place = line_dedup.shared_path(spark, "runs")
    store = line_dedup.LineRuns(spark, place, fanout=2)
    keys = line_dedup.line_keys(docs).cache()
    for b in range(4):
        store.add(keys.filter(f"doc_id % 4 = {b}"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    whole = {(*k, n, last) for k, (n, last) in _totals(keys).items()}
    assert {tuple(r) for r in store.totals().collect()} == whole
    assert store.unseen(keys).count() == 0
    one = line_dedup.LineRuns(spark, line_dedup.shared_path(spark, "runs"), fanout=9)
    one.add(keys)                                      # a single batch gives the same
    assert {tuple(r) for r in one.totals().collect()} == whole
    assert line_dedup.LineRuns(spark, line_dedup.shared_path(spark, "runs")).totals().count() == 0


def test_line_runs_reopened(spark, docs):
    """A store that is opened again for every batch ends like one that is fed at once; the
    merge join tells new keys from known ones; runs meet without a shuffle."""
    from rosterlake.plans.checks import physical_plan

    place = line_dedup.shared_path(spark, "runs")
    keys = line_dedup.line_keys(docs).cache()
    for b in range(7):
        part = keys.filter(f"doc_id % 7 = {b}")
        store = line_dedup.LineRuns(spark, place, fanout=3)
        known = {(r.h1, r.h2) for r in store.totals().collect()}
        counted = part.groupBy("h1", "h2").agg({"doc_id": "max", "*": "count"}).toDF("h1", "h2", "last", "n")
        assert {(r.h1, r.h2) for r in store.merged(counted).filter("fresh").collect()} == {(r.h1, r.h2) for r in part.collect()} - known
        store.add(part)
    again = line_dedup.LineRuns(spark, place, fanout=3)
    assert again.batches == 7 and [len(x) for x in again.levels] == [1, 2]
    assert {tuple(r) for r in again.totals().collect()} == {(*k, n, last) for k, (n, last) in _totals(keys).items()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = physical_plan(line_dedup.LineRuns(spark, place, fanout=3).totals())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def _totals(keys):
    out = defaultdict(set)
    for r in keys.collect():
        out[r.h1, r.h2].add(r.doc_id)
    return {k: (len(v), max(v)) for k, v in out.items()}


def test_quality_rules_counts(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_columns(docs).collect()}
    for d, t, *_ in corpus():
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        count = Counter(tri)
        cov = {j for i, x in enumerate(tri) if count[x] > 1 for j in (i, i + 1, i + 2)}
        wordy = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(wordy) - len(set(wordy)), len(cov))
        assert r.base_failed == (len(w) < 50 or 100 * len(cov) > 50 * len(w))
    assert quality_rules.quality_columns(empty).count() == 0


def test_quality_lines(spark):
    prose = "\n".join("Sentence%d, with%d words%d in%d it%d; it%d goes%d on%d." % ((k,) * 8) for k in range(10))
    menu = "\n".join("Home | News | Sport | Weather | About us | Contact" for _ in range(30))
    shout = " ".join("word%d***" % k for k in range(80))
    rows = [(1, prose), (2, prose + "\n" + menu), (3, shout), (4, prose + "\nAll rights reserved.")]
    got = {r.doc_id: r for r in quality_rules.quality_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.kept for d, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert got[4].clean_text == prose == got[1].clean_text


def test_language_id_held_out(spark, empty):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out and lang_pred <> 'und'").join(truth, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(empty.select("doc_id", "text", "lang")).count() == 0
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34 !", "en"), (3, "the and", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und"}


BODY = "Some longer running text, that goes on for a while, with commas and stops, until it ends here."


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("plain text", "plain text"),
    (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p><b>{BODY}<br><p>{BODY}</article><footer>&copy; x</footer>", f"T & U\n{BODY}\n{BODY}"),
    (f"<div class='main-content'><h1>T</h1><p>{BODY}</p><div class='comments'><p>{BODY}</p></div></div><aside>{BODY}</aside>", f"T\n{BODY}"),
    (f"<div class=cookie-notice>{BODY}</div><article><p>a  b\n c</p><ul><li>one</li></ul><script>if(a<b)</script></article><form>x</form>", "a b c\none"),
    (f"<main><p>{BODY}</p><div class=sidebar><p>{BODY}</p></div></main><!-- cut", BODY),
])
def test_pages(page, want):
    counts: Counter = Counter()
    for seed in html_extract.SEEDS:
        html_extract.count_page(seed, counts, html_extract.SEED_WEIGHT)
    for k in range(50):
        html_extract.count_page(f"<nav><ul><li><a>m{k}</a></ul></nav><div class=ad>{BODY}</div><article><h1>T</h1><p>{BODY}</p></article><footer>f</footer>", counts)
    assert html_extract.PageModel(dict(counts)).extract(page) == want


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><h1>T</h1>{BODY}<br>{BODY}<div class=footer>x</div>", f"T\n{BODY} {BODY}"),
    (f"<body class=has-sidebar><ul class=menu><li><a>Home</a></ul>{BODY} {BODY}<p>{BODY}</p></body>", f"{BODY} {BODY}\n{BODY}"),
    (f"<nav><a>Home</a></nav> | <article><p>{BODY}</p></article> &copy; us <footer>x</footer>", BODY),
    (f"<body><a>Home</a> | <a>News</a><div class=content><p>{BODY}</p></div>Imprint</body>", BODY),
    ("<article><svg-icon name=x></svg-icon><p>main text</p></article>", "main text"),
    (f"<form><datalist><option value=a></datalist></form><article><p>{BODY}</p></article>", BODY),
    (f"<article><a><svg><g><text>no</text></g></a><p>{BODY} <svg viewBox='0'><path/><text>no</text></svg>yes <math><mi>x</mi></math></p></article>", f"{BODY} yes"),
    (f"<article><svg/><p data-y=x>{BODY}</p><option>no<p>{BODY}</p></article>", f"{BODY}\n{BODY}"),
])
def test_loose_text_and_nested_elements(page, want):
    test_pages(page, want)


@pytest.mark.parametrize("page, want", [
    ("<article><p>short</p><p><a href=x>Only a link</a></p></article>", "short\nOnly a link"),
    ("<article><h1>T</h1><p><a>Only a link</a></p></article>", "T\nOnly a link"),
    (f"<nav><a>Home</a></nav><main><p>{BODY}</p><ul><li><a>source one</a></li><li><a>two</a></li></ul></main>", f"{BODY}\nsource one\ntwo"),
    (f"<article><h1>T</h1><p>{BODY}</p><div class=share><ul><li><a>Mail</a></li></ul></div><aside><p>x</p></aside><nav><p>next</p></nav></article>", f"T\n{BODY}"),
])
def test_short_and_linked_paragraphs_of_an_article(page, want):
    test_pages(page, want)


def test_pages_edge_cases(spark):
    """Empty table, repeated rows, a very long page, columns named like results."""
    long = "<article>" + "".join(f"<p>{BODY} {k}</p>" for k in range(4000)) + "</article>"
    rows = [(1, "u", long, "own", 7), (1, "u", long, "own", 7), (2, "u", f"<article><p>{BODY}</p></article>", "own", 7), (2, "v", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    model = html_extract.train(pages)
    out = html_extract.extract(pages, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in out.collect())
    want = "\n".join(f"{BODY} {k}" for k in range(4000))
    assert got == [(1, "u", want, len(want))] * 2 + [(2, "u", BODY, len(BODY)), (2, "v", "", 0)]
    assert html_extract.extract(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0


def test_language_id_edge_cases(spark):
    """Very long texts, repeated rows, ties between equal rows, columns named like results, an empty table."""
    text = {"en": "the cat and the dog are in the house with the bird ", "fr": "le chat et le chien sont dans la maison avec un oiseau "}
    rows = [(k, text[lang] * (1 + k % 3), lang, "own", 0.5) for k in range(60) for lang in ("en" if k % 2 else "fr",)]
    rows += [(1000, text["fr"] * 20_000, None, "own", 0.5), (1000, text["fr"] * 20_000, None, "own", 0.5), (1001, None, "en", None, None), (1002, " 12 .", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language_id.identify(docs)
    got = sorted((r.doc_id, r.lang_pred) for r in out.collect())
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in out.collect())
    assert [g for g in got if g[0] >= 1000] == [(1000, "fr"), (1000, "fr"), (1001, "und"), (1002, "und")]
    assert all(p == ("en" if d % 2 else "fr") for d, p in got if d < 1000)
    assert language_id.identify(docs.limit(0)).count() == 0


def test_bpe_columns_named_like_results(spark):
    rows = [(1, "some words", "own", 3), (1, "some words", "own", 3), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode_documents(docs, queries.tokenizer_path())
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert sorted((r.doc_id, r.n_tokens, len(r.ids)) for r in out.where("doc_id = 1").collect()) == [(1, 3, 2)] * 2
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.encode_digests(docs, queries.tokenizer_path()).collect()) == [(1, 2), (1, 2), (2, 0)]


def test_marginals_with_a_body():
    from itertools import product
    counts: Counter = Counter()
    for seed in html_extract.SEEDS:
        html_extract.count_page(seed, counts)
    m = html_extract.PageModel(dict(counts))
    nodes, _ = html_extract.parse(f"<body><h1>T</h1>{BODY}<div class=ad><p>x</p></div><p>{BODY}</p>")
    phi = [m.unary(*e[1:]) for e in html_extract._emissions(nodes)]
    total, yes = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        p = 1.0
        for k, n in enumerate(nodes):
            p *= m.tree[2 if n.parent < 0 else y[n.parent] + 3 * (n.parent == 0), n.hint, n.cat][y[k]] * phi[k][y[k]]
        total += p
        yes = [a + p * b for a, b in zip(yes, y, strict=True)]
    assert nodes[0].tag == "body" and m.marginals(nodes) == pytest.approx([v / total for v in yes])


def test_marginals_are_exact():
    """Sum-product against all assignments of a small tree."""
    from itertools import product
    counts: Counter = Counter()
    for seed in html_extract.SEEDS:
        html_extract.count_page(seed, counts)
    m = html_extract.PageModel(dict(counts))
    nodes, _ = html_extract.parse(f"<div><h1>T</h1><div class=ad><p>x</p></div><p>{BODY}</p></div>")
    phi = [m.unary(*e[1:]) for e in html_extract._emissions(nodes)]
    total, yes = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        p = 1.0
        for k, n in enumerate(nodes):
            p *= m.tree[y[n.parent] if n.parent >= 0 else 2, n.hint, n.cat][y[k]] * phi[k][y[k]]
        total += p
        for k in range(len(nodes)):
            yes[k] += p * y[k]
    assert m.marginals(nodes) == pytest.approx([v / total for v in yes])


def test_pages_query(spark):
    rows = queries.op10_html_extract(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, "u", None), (2, "u", "")], "page_id long, url string, html string")
    model = html_extract.train(odd)
    assert [r.text for r in html_extract.extract(odd, model).collect()] == ["", ""]
