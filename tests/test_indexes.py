"""The vector index (X13) and the substring index (X1, X11b) against the plain searches."""

import random

import numpy as np
import pytest

from conftest import SF_MID
from rosterlake.operators import names, search, vectors
from rosterlake.plans.checks import physical_plan
from rosterlake.sources.model import LeagueModel

KIND = "vec_id long, embedding array<double>"


def _recall(got, want) -> float:
    got = {(r.query_id, r.vec_id) for r in got}
    want = {(r.query_id, r.vec_id) for r in want}
    return len(got & want) / len(want)


@pytest.fixture(scope="module")
def hot(spark):
    """Vectors around 20 directions, a third of them copies of one vector."""
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + .3 * rnd.normal(size=16)).tolist()) for i in range(1000)]
    rows += [(1000 + i, base[3].tolist()) for i in range(500)] + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def test_index_recall_on_the_driver_table(spark):
    from rosterlake.catalog import QUERIES, TOP_K, _every_20th
    emb = LeagueModel(spark, SF_MID).t.table("embeddings")
    exact = vectors.nearest_vectors(emb, _every_20th(emb), TOP_K).collect()
    assert _recall(QUERIES["nearest_vectors_index"](spark, SF_MID).collect(), exact) >= 0.9


def test_index_holds_every_row_and_splits_hot_cells(spark, hot):
    cells = vectors.fit_cells(hot, cells=24)
    index = vectors.build_index(hot, cells)
    assert index.count() == 1501 and index.select("vec_id").distinct().count() == 1501      # with the zero vector, without the unusable
    q = hot.where("vec_id % 20 = 0 and vec_id < 1000").selectExpr("vec_id as query_id", "embedding as query_vector")
    exact = vectors.nearest_vectors(hot, q, 5).collect()
    found = vectors.search_index(index, cells, q, 5, part_rows=100).collect()
    assert _recall(found, exact) >= 0.9
    every = vectors.search_index(index, cells, q, 5, probes=24, part_rows=100).collect()    # all cells: exact
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.similarity)
    assert sorted(map(key, every)) == sorted(map(key, exact))


def test_exact_search_does_not_depend_on_parts_and_tiles(spark, hot):
    q = hot.where("vec_id < 40").selectExpr("vec_id as query_id", "embedding as query_vector")
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.similarity)
    want = sorted(map(key, vectors.nearest_vectors(hot, q, 6).collect()))
    assert sorted(map(key, vectors.nearest_vectors(hot, q, 6, part_rows=97, tile_rows=7).collect())) == want and len(want) == 240
    assert vectors.nearest_vectors(hot, q.limit(0), 6).count() == 0 and vectors.nearest_vectors(hot.limit(0), q, 6).count() == 0
    cells = vectors.fit_cells(hot.limit(0))
    assert vectors.search_index(vectors.build_index(hot.limit(0), cells), cells, q, 6).count() == 0


def test_found_names_equal_ilike_for_every_word(spark):
    rnd = random.Random(9)
    people = [(i, "".join(rnd.choice("abAB é'_%") for _ in range(rnd.randrange(0, 9)))) for i in range(300)] + [(900, None), (901, "Ab_c"), (901, "Ab_c")]
    g = spark.createDataFrame(people, "id long, nome string")
    index = names.name_index(g).cache()
    words = sorted({"".join(rnd.choice("abB é%_'") for _ in range(rnd.randrange(1, 6))) for _ in range(80)} | {"ab", "AB", "é", "zzz", "a%b"})
    words = [w for w in words if w.strip("%_")]
    found = names.find_names(index, g.distinct(), spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "word string"))
    got = sorted((r.word, r.id) for r in found.collect())
    want = sorted((w, r.id) for w in words for r in g.distinct().where(search.F.col("nome").ilike(search.like_pattern(w))).collect())
    assert got == want and len(want) > 500
    with pytest.raises(Exception, match="no literal character"):
        names.find_names(index, g, spark.createDataFrame([("%_",)], "word string")).collect()
    assert names.find_names(index, g, spark.createDataFrame([], "word string")).count() == 0


def test_search_reads_postings_of_the_rarest_keys(spark):
    g = spark.createDataFrame([(i, "common" if i % 50 else "common rare") for i in range(2000)], "id long, nome string")
    index = names.name_index(g)
    assert index.where("key = 'com'").count() == 2000
    found = names.find_names(index, g, spark.createDataFrame([("on ra",)], "word string"))
    assert found.count() == 40


def _broadcast_lines(df) -> str:
    """The lines of the plan that stand below a broadcast."""
    out, depth = [], None
    for line in physical_plan(df).splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
        else:
            depth = None
    return "\n".join(out)


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Players in a small file: by its size Spark would broadcast them, and the postings with them."""
    path = str(tmp_path_factory.mktemp("names") / "g.parquet")
    rows = [(i, f"{'red' if i % 3 else 'blue'} ring {i % 7}", "A", "Brand#1", 1.0, float(i % 5)) for i in range(200)] + [(None, "red null", "A", None, None, None)]
    spark.createDataFrame(rows, "id long, nome string, ruolo string, squadra string, quotazione_attuale double, fvm double").write.parquet(path)
    return spark.read.parquet(path)


def test_live_searches_send_no_postings_or_players_through_the_driver(spark, few):
    sold = spark.createDataFrame([(3,), (3,), (None,)], "giocatore_id long")
    words = spark.createDataFrame([("red",), ("LUE R",), ("%4",)], "word string")
    found = names.live_searches(names.name_index(few), few, sold, words, limit=4)
    assert "nome" not in _broadcast_lines(found)
    got = sorted((r.word, r["rank"], r.id) for r in found.collect())
    want = [(w.word, k, r.id) for w in words.collect() for k, r in enumerate(search.free_search(few, sold, w.word).limit(4).collect(), 1)]
    assert got == sorted(want) and len(want) == 12


def test_found_names_send_no_postings_or_players_through_the_driver(spark, few):
    words = spark.createDataFrame([("red",), ("LUE R",), ("%4",), ("re",)], "word string")
    found = names.find_names(names.name_index(few), few, words).select("word", "id")
    assert "nome" not in _broadcast_lines(found)
    got = sorted((r.word, r.id) for r in found.collect())
    assert got == sorted((w.word, r.id) for w in words.collect() for r in few.where(search.F.col("nome").ilike(search.like_pattern(w.word))
                                                                                    & search.F.col("id").isNotNull()).collect())
