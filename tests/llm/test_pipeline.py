"""Every stage of the pipeline, text by text, against plain Python (and the tokenizers
library), and the SQL and the plans of the operators' queries."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from rosterlake.llm import quality_rules as q
from rosterlake.llm import queries
from rosterlake.plans.checks import forbidden_operators

SMALL = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
KINDS = "doc_id long, text string, lang string, source string, n_chars int, kept string, items string"


def table() -> list[tuple]:
    """Documents with copies, near copies, common lines, benchmark passages, junk, and edge cases."""
    rnd = random.Random(31)
    vocab = ["w%d" % k for k in range(600)] + ["Émile", "naïve", "中文", "don't"]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    item = BENCH[0][1]
    line = "This very line stands in many of the documents here."
    texts: list[str | None] = [None, "", " \n\t", "short", prose(49), "a b c " * 200, "€" * 300, prose(4000)]
    for k in range(70):
        body = [prose(rnd.randrange(20, 60)) for _ in range(3)]
        if k % 4 == 0:
            body.insert(1, f"  {line.upper() if k % 8 else line}\t")
        if k % 9 == 0:
            body.append("Home | News | Sport | Weather | About")
        if k % 11 == 0:
            body += ["All rights reserved.", "### *** $$$ !!! ###"] * (6 if k % 2 else 1)
        if k % 10 == 0:
            body.insert(0, f"{prose(5)}, {item.upper()}: {prose(5)}")
        text = "\n".join(body)
        texts.append(text)
        if k % 6 == 0:
            texts += [text, text]
        if k % 7 == 0:
            w = text.split(" ")
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        if k == 12:
            texts.append("\n".join([prose(7), item, prose(8)]))                # mostly benchmark
            texts.append("\n".join([BENCH[1][1] * 3, prose(30)]))
    rnd.shuffle(texts)
    rows = [(5 * i, t, "en", "s", len(t) if t else 0, "own", "own") for i, t in enumerate(texts)]
    return rows + [(None, prose(60), "en", "s", 1, None, None), (None, prose(60), None, None, None, None, None)]


BENCH = [("i1", " ".join("bench%d" % k for k in range(40))), ("i2", "tiny item"), ("i3", None), (None, "unnamed words here")]


def words(text: str) -> list[str]:
    return [x for x in re.split(f"[{WS}]+", text) if x]


def good_lines(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        size = sum(c not in WS for c in line)
        marks, seps = sum(c in q.LINE_MARKS for c in line), sum(c in q.NAV_SEPARATORS for c in line)
        breaks = sum(c in " \t" for c in line)
        bad = (marks >= q.MIN_MARKS and marks > size * q.MAX_MARK_SHARE
               or seps >= q.MIN_NAV_SEPARATORS and breaks + 1 <= (seps + 1) * (q.MAX_NAV_WORDS_PER_ITEM + 1)
               or breaks < q.MAX_BOILERPLATE_WORDS and re.search(q.BOILERPLATE, line))
        if not bad:
            out.append(line)
    return out


def stage_quality(docs: list[tuple]) -> list[tuple]:
    out = []
    for d, t in docs:
        w = words(t or "")
        tri = defaultdict(list)
        for i in range(len(w) - 2):
            tri[tuple(w[i:i + 3])].append(i)
        repeat = {i + k for at in tri.values() if len(at) > 1 for i in at for k in range(3)}
        if len(w) < q.MIN_WORDS or 100 * len(repeat) > q.MAX_REPEAT_PERCENT * len(w):
            continue
        clean = "\n".join(good_lines(t))
        size = lambda x: sum(c not in WS for c in x)
        if size(t) - size(clean) <= size(t) * q.MAX_LOST_SHARE:
            out.append((d, clean))
    return out


def stage_lines(docs: list[tuple]) -> list[tuple]:
    key = lambda x: x.strip(WS).translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for d, t in docs:
        if d is not None:
            for x in t.split("\n"):
                if len(key(x)) >= 20:
                    holders[key(x)].add(d)
    gone = lambda d, x: d is not None and len(holders.get(key(x), ())) >= 3 and d != max(holders[key(x)])
    return [(d, "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in docs]


def stage_near(docs: list[tuple]) -> list[tuple]:
    sets = []
    for d, t in docs:
        w = words(t.translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                    root[find(a)] = find(b)
    least: dict = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [(d, t) for k, (d, t) in enumerate(docs) if d is None or least[find(k)] == d]


def stage_benchmark(docs: list[tuple]) -> list[tuple]:
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
    lower = lambda m: m.group().translate({i: i + 32 for i in range(65, 91)})
    windows = set()
    for _, t in BENCH:
        v = [lower(m) for m in find(t or "")]
        n = min(10, len(v))
        windows |= {tuple(v[i:i + n]) for i in range(len(v) - n + 1) if n}
    out = []
    for d, t in docs:
        found = find(t)
        w, hit = [lower(m) for m in found], set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
        if len(hit) > .5 * len(w):
            continue
        text, last = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                text += t[last:found[i].start()]
            if i + 1 not in hit:
                last = found[i].end()
        out.append((d, text + t[last:]))
    return out


def key(row) -> tuple:
    return row[0] is None, row[0] or 0, row[1] is None, row[1] or ""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(table(), KINDS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_plain_python(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [(d, t) for d, t, *_ in table()]
    steps = [stage_quality, stage_lines, stage_near, stage_benchmark]
    sizes = [len(want)]
    for k, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, steps)):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == docs.columns, name
        want = brute(want)
        rows = out.collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(want, key=key), name
        assert all(r.kept in ("own", None) and (k == 2 or r.n_chars is None or r.n_chars == len(r.text)) for r in rows), name
        sizes.append(len(rows))
        docs = out
    assert sizes[0] > sizes[1] > sizes[3] > sizes[4] and sizes[1] == sizes[2]
    library = Tokenizer.from_file(queries.tokenizer_path())
    final = corpus_pipeline.tokens(spark, docs, folder).collect()
    ids = {key(x): library.encode(x[1] or "", add_special_tokens=False).ids for x in want}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expect = sorted((d is None, d or 0, tuple(i := ids[key((d, t))]), len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, t in want)
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in final) == expect
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in whole) == sorted((a, b, e) for a, b, _, _, e, _ in expect)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    assert forbidden_operators(queries.QUERIES[name](spark, SMALL)) == []
