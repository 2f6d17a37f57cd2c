"""The change feed of two snapshots and the documents that follow it (T4)."""

import random

import pytest

from rosterlake.operators import changes, documents
from rosterlake.streaming import feeds

PLAYERS = "id long, nome string, ruolo string, squadra string, quotazione_attuale double, fvm double"
STATS = ("giocatore_id long, stagione string, presenze int, gol int, assist int, media_voto double, fantamedia double")
ROSTER = "giocatore_id long, prezzo_pagato double"


def _tables(spark, players, stats, roster):
    return {"giocatori": spark.createDataFrame(players, PLAYERS), "statistiche_storiche": spark.createDataFrame(stats, STATS),
            "mia_rosa": spark.createDataFrame(roster, ROSTER)}


def test_changes_against_dicts(spark):
    rnd = random.Random(1)
    rows = lambda: [(rnd.choice([None, *range(30)]), rnd.choice(["a", "b", None]), rnd.randrange(2)) for _ in range(40)]
    a, b = rows(), rows()
    b += a[:15]
    by_key = lambda rs: {k: sorted((r for r in rs if r[0] == k), key=repr) for k in {r[0] for r in rs}}
    old, new = by_key(a), by_key(b)
    want = {(k, "insert" if k not in old else "delete" if k not in new else "update") for k in {*old, *new} if old.get(k) != new.get(k)}
    kinds = "k long, x string, y int"
    got = changes.snapshot_changes(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds).repartition(3), ["k"])
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert changes.snapshot_changes(spark.createDataFrame(a, kinds), spark.createDataFrame(a[::-1], kinds), ["k"]).count() == 0
    assert changes.snapshot_changes(spark.createDataFrame([], kinds), spark.createDataFrame([], kinds), ["k"]).count() == 0


def test_documents_follow_deletes_seasons_and_roster(spark, tmp_path):
    p = [(i, f"P{i}", "C", "X", 1.0, None) for i in range(1, 7)]
    st = [(i, "2023/24", 10, 1, 1, 6.0, 6.5) for i in range(1, 7)]
    first = _tables(spark, p, st, [(1, 5.0)])
    log = str(tmp_path / "log")
    empty = {k: v.limit(0) for k, v in first.items()}
    changes.sync_documents(empty, first, log, 0)
    # 1 leaves the roster, 2 is deleted (with its season), 3 gets a season, 4 a name, 7 is new; 5 and 6 stay
    p2 = [p[0], p[2], (4, "Renamed", "C", "X", 1.0, None), p[4], p[5], (7, "P7", "A", "Y", 2.0, 9.0)]
    st2 = [s for s in st if s[0] != 2] + [(3, "2024/25", 5, 0, 0, 6.0, 6.0), (99, "2024/25", 1, 0, 0, 6.0, 6.0)]
    second = _tables(spark, p2, st2, [])
    got = {(r.id, r.change) for r in changes.changed_players(first, second).collect()}
    assert got == {(1, "update"), (2, "delete"), (3, "update"), (4, "update"), (7, "insert")}
    for _ in range(2):                                       # a replay changes nothing
        changes.sync_documents(first, second, log, 1)
    now = {r.id: r.document for r in changes.current_documents(spark.read.parquet(log)).collect()}
    want = {r.id: r.document for r in documents.player_documents(*(second[k] for k in ("giocatori", "statistiche_storiche", "mia_rosa"))).collect()}
    assert now == want and "2" not in now and "MIA ROSA" not in now["1"] and "2024/25" in now["3"]
    assert spark.read.parquet(f"{log}/_batch=1").count() == 5


@pytest.mark.parametrize("column", ["id", "giocatore_id"])
def test_stream_of_ids_with_deletes(spark, tmp_path, column):
    t = _tables(spark, [(1, "One", "C", "X", 1.0, None), (2, "Two", "C", "X", 1.0, None)], [], [])
    src, log = tmp_path / "ids", str(tmp_path / "log")
    kinds = f"{column} long, change string"
    args = (t["statistiche_storiche"], t["mia_rosa"], log, str(tmp_path / "ck"))

    def run(rows, name):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(src / name))
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(str(src))
        feeds.document_sync(stream, *args, giocatori=t["giocatori"]).awaitTermination(120)
        return {r.id for r in feeds.current_documents(spark.read.parquet(log)).collect()}

    assert run([(1, "insert"), (2, "insert"), (1, None), (8, "update"), (None, "update")], "a") == {"1", "2"}
    assert run([(2, "delete")], "b") == {"1"}
    assert run([(2, "update")], "c") == {"1", "2"}          # back again
