"""X4 against a literal transcription of its steps; league fan-out and flop; documents; k-NN."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.operators import documents, league, players, score

G_DDL = "id long, nome string, ruolo string, squadra string, quotazione_attuale double, fvm double"
S_DDL = "giocatore_id long, stagione string, fantamedia double, presenze int"


def _half_up(x, n):
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-6)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def _expected_python(gioc, stats, sold, limit=20):
    """The eight steps of the score as plain Python over lists."""
    weights = [3, 2, 1, 0.5]
    res = []
    for gid, nome, ruolo, squadra, quot, fvm in gioc:
        if gid in sold:
            continue
        seasons = sorted([s for s in stats if s[0] == gid], key=lambda s: s[1], reverse=True)[:4]
        n = len(seasons)
        sw = sum(weights[:n])
        if n:
            fm = sum((s[2] or 0) * w for s, w in zip(seasons, weights)) / sw
            pr = sum((s[3] or 0) * w for s, w in zip(seasons, weights)) / sw
        else:
            fm, pr = None, 0.0
        aff = 0.30 if pr < 10 else 0.60 if pr < 20 else 0.85 if pr < 28 else 1.00
        res.append(dict(id=gid, ruolo=ruolo, fvm=fvm or 0.0, fm=None if fm is None else _half_up(fm, 2), aff=aff))
    for r in {x["ruolo"] for x in res}:
        sub = [x for x in res if x["ruolo"] == r]
        mf = max(x["fvm"] for x in sub) or 1
        mm = max((x["fm"] or 0) for x in sub) or 1
        for x in sub:
            x["score"] = _half_up((x["fvm"] / mf * 0.60 + (x["fm"] or 0) / mm * 0.40) * x["aff"] * 100, 1)
    res.sort(key=lambda x: (-x["score"], x["id"]))
    return [(x["id"], x["score"]) for x in res[:limit]]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("PDCA"), st.one_of(st.none(), st.integers(0, 60))), min_size=1, max_size=8),
       st.lists(st.tuples(st.integers(0, 7), st.integers(2017, 2024),
                          st.one_of(st.none(), st.integers(0, 90)), st.one_of(st.none(), st.integers(0, 38))),
                max_size=25),
       st.sets(st.integers(0, 7), max_size=3))
def test_expected_value_matches_python(spark, players_, seasons_, sold):
    gioc = [(i, f"p{i}", r, "X", 1.0, None if f is None else float(f)) for i, (r, f) in enumerate(players_)]
    seen, stats = set(), []
    for gid, y, fm, pr in seasons_:
        if (gid, y) not in seen:
            seen.add((gid, y))
            stats.append((gid, f"{y}/{(y + 1) % 100:02d}", None if fm is None else fm / 10, pr))
    g = spark.createDataFrame(gioc, G_DDL)
    s = spark.createDataFrame(stats, S_DDL) if stats else spark.createDataFrame([], S_DDL)
    a = spark.createDataFrame([(x,) for x in sold] + [(None,)], "giocatore_id long")
    got = [(r.id, r.score) for r in score.expected_value(g, s, a).collect()]
    assert got == _expected_python(gioc, stats, sold)


def test_league_fan_out_counts_every_purchase(spark):
    asta = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A"), (2, "B")], "giocatore_id long, squadra_acquirente string")
    voti = spark.createDataFrame([(1, 1, 6.0), (1, 2, None), (2, 1, 7.0)], "giocatore_id long, giornata int, fantavoto double")
    got = {r.squadra: (r.giornate_giocate, r.punti_totali, r.fantamedia_squadra)
           for r in league.league_table(asta, voti).collect()}
    assert got == {"A": (2, 12.0, 6.0), "B": (2, 13.0, 6.5)}


def test_flop_counts_null_as_zero(spark):
    voti = spark.createDataFrame([(1, 1, 5, 5.0, 0.0), (2, 2, 5, 5.0, None), (3, 3, 5, 5.0, -1.0)],
                                 "id long, giocatore_id long, giornata int, voto double, fantavoto double") \
        .withColumn("gol", F.lit(0)).withColumn("assist", F.lit(0)) \
        .withColumn("ammonizione", F.lit(False)).withColumn("espulsione", F.lit(False))
    g = spark.createDataFrame([(i, f"p{i}", "P", "X", 1.0, 1.0) for i in (1, 2, 3)], G_DDL)
    asta = spark.createDataFrame([], "id long, giocatore_id long, squadra_acquirente string")
    top = [r.nome for r in league.round_top(voti, g, asta, 5).collect()]
    flop = [r.nome for r in league.round_flop(voti, g, asta, 5).collect()]
    assert top == ["p1", "p3", "p2"]
    assert flop == ["p3", "p1", "p2"]   # NULL counts as 0, after the real 0 (top order kept)


def test_short_documents_drop_null_parts(spark):
    g = spark.createDataFrame([(1, "Rossi", "P", "Inter", 10.0, None)], G_DDL)
    doc = documents.short_documents(g).first().testo_embedding
    assert doc == "Nome: Rossi | Ruolo: P | Squadra: Inter | Quotazione: 10.0"


def test_player_documents_text(spark):
    g = spark.createDataFrame([(1, "Rossi", "P", "Inter", 10.0, None), (2, "Neri", "D", "Roma", 5.0, 40.0)], G_DDL)
    s = spark.createDataFrame([(1, "2023/24", 30, 1, 0, 6.0, None), (1, "2024/25", 20, 0, 1, 6.5, 7.0)],
                              "giocatore_id long, stagione string, presenze int, gol int, assist int, "
                              "media_voto double, fantamedia double")
    mr = spark.createDataFrame([(2, 12.0)], "giocatore_id long, prezzo_pagato double")
    docs = {r.giocatore_id: r.document for r in documents.player_documents(g, s, mr).collect()}
    assert docs[1] == ("Rossi (P, Inter). Quotazione attuale: 10.0. "
                       "Stagione 2024/25: 20 presenze, 0 gol, 1 assist, media voto 6.5, fantamedia 7.0. "
                       "Stagione 2023/24: 30 presenze, 1 gol, 0 assist, media voto 6.0, fantamedia None. ")
    assert docs[2] == ("Neri (D, Roma). Quotazione attuale: 5.0. Fantavalore di mercato (FVM): 40.0. "
                       "E' nella MIA ROSA, pagato 12.0 crediti.")


def test_nearest_vectors_equal_brute_force(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = documents.label_centroids(emb).select(F.col("query_id").cast("long"), "query_vector")
    got = {(r.query_id, r.rank): r.vec_id for r in documents.nearest_vectors(emb, q, 5).collect()}
    pdf = emb.toPandas()
    mat = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    for lab in sorted(pdf.label.unique()):
        c = mat[pdf.label.to_numpy() == lab].mean(axis=0)
        sims = mat @ c / (np.linalg.norm(mat, axis=1) * np.linalg.norm(c))
        order = np.lexsort((pdf.vec_id.to_numpy(), -sims))[:5]
        assert [got[(int(lab), k + 1)] for k in range(5)] == list(pdf.vec_id.to_numpy()[order])


def test_recent_messages_and_compare_ids(spark):
    conv = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(6)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in documents.recent_messages(conv, 3).collect()] == [3, 4, 5]
    g = spark.createDataFrame([(i, f"p{i}", "P", "X", 1.0, 1.0) for i in range(1, 7)], G_DDL)
    s = spark.createDataFrame([], "giocatore_id long, stagione string, fantamedia double, media_voto double, "
                                  "presenze int, gol int, assist int, ammonizioni int")
    ids = [r.id for r in players.compare_players(g, s, ["1", " 2", "2", "5", "6"]).collect()]
    assert sorted(ids) == [1, 2, 5]          # first four of the list, duplicates count
    assert sorted(r.id for r in players.compare_players(g, s, "3, 4,4,6,1").collect()) == [3, 4, 6]
    import pytest
    with pytest.raises(ValueError):
        players.compare_players(g, s, "1,x")


def test_nearest_vectors_skips_null_and_bad_length(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [0.6, 0.8])],
                                "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<double>")
    got = [(r.rank, r.vec_id) for r in documents.nearest_vectors(emb, q, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 5)]


def test_nearest_vectors_skips_zero_vectors_and_keeps_ties(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [3.0, 0.0])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<double>")
    got = [(r.vec_id, r.similarity) for r in documents.nearest_vectors(emb, q, 2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0)]
    every = documents.nearest_vectors(emb, q, 9).orderBy("rank").collect()
    assert [r.vec_id for r in every] == [1, 2, 4, 3]


def test_repeated_fresh_documents(spark):
    cur = spark.createDataFrame([(1, "old"), (2, "keep")], "id long, document string")
    fresh = spark.createDataFrame([(1, "a"), (1, "b")], "id long, document string")
    assert sorted(tuple(r) for r in documents.upsert_documents(cur, fresh).collect()) == [(1, "b"), (2, "keep")]
