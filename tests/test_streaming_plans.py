"""Streams T2-T4 and plan shape of the registered queries."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rosterlake.catalog import QUERIES
from rosterlake.operators import auction
from rosterlake.plans.checks import forbidden_operators, has_group_limit, pushed_filters
from rosterlake.sources.model import LeagueModel
from rosterlake.streaming import feeds

LOG_DDL = "id long, ts timestamp_ntz, level string, message string, extra string, app_name string"


def test_log_sink_restart_no_loss_no_doubles(spark, tmp_path):
    logs = LeagueModel(spark, SF_SMALL).app_logs
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    logs.where("id < 400").write.parquet(str(src / "a"))
    stream = spark.readStream.schema(LOG_DDL).option("recursiveFileLookup", True).parquet(str(src))
    feeds.log_sink(stream, str(out), str(ck), available_now=True).awaitTermination(120)
    logs.where("id >= 400").write.parquet(str(src / "b"))
    # restart from the same checkpoint: only the new file is read
    stream = spark.readStream.schema(LOG_DDL).option("recursiveFileLookup", True).parquet(str(src))
    feeds.log_sink(stream, str(out), str(ck), available_now=True).awaitTermination(120)
    written = spark.read.parquet(str(out))
    assert written.count() == logs.count()
    assert written.select("id").distinct().count() == logs.count()


def test_scoreboard_and_document_sync(spark, tmp_path):
    m = LeagueModel(spark, SF_SMALL)
    src = tmp_path / "asta"
    m.asta_log.write.parquet(str(src))
    stream = spark.readStream.schema(m.asta_log.schema).parquet(str(src))
    q = (feeds.scoreboard(stream).writeStream.format("memory").queryName("board_t3")
         .outputMode("complete").option("checkpointLocation", str(tmp_path / "ck3")).start())
    q.processAllAvailable()
    q.stop()
    board = feeds.scoreboard_with_budget(spark.table("board_t3"), m.squadre)
    spent = {r.nome: r.budget_speso for r in board.collect()}
    want = {r.nome: r.budget_speso for r in QUERIES["team_budgets"](spark, SF_SMALL).collect()}
    assert spent == want

    players_src = tmp_path / "players"
    m.giocatori.write.parquet(str(players_src / "v1"))
    docs = tmp_path / "docs"
    changed = spark.readStream.schema(m.giocatori.schema).option("recursiveFileLookup", True).parquet(str(players_src))
    feeds.document_sync(changed, m.statistiche, m.mia_rosa, str(docs), str(tmp_path / "ck4")).awaitTermination(120)
    m.giocatori.where("id = 1").withColumn("nome", F.lit("Renamed")).write.parquet(str(players_src / "v2"))
    changed = spark.readStream.schema(m.giocatori.schema).option("recursiveFileLookup", True).parquet(str(players_src))
    feeds.document_sync(changed, m.statistiche, m.mia_rosa, str(docs), str(tmp_path / "ck4")).awaitTermination(120)
    cur = feeds.current_documents(spark.read.parquet(str(docs)))
    assert cur.count() == m.giocatori.count()
    assert cur.where("id = '1'").first().document.startswith("Renamed (")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    assert forbidden_operators(QUERIES[name](spark, SF_SMALL)) == []


def test_group_limits_and_pushdown(spark):
    m = LeagueModel(spark, SF_SMALL)
    # X4's newest-4-seasons window runs in the job that fills its checkpoint
    from rosterlake.operators import score
    form = score.player_form(m.statistiche)
    form.collect()
    assert has_group_limit(form)
    cand = QUERIES["strategy_candidates"](spark, SF_SMALL)
    cand.collect()
    assert has_group_limit(cand)
    pushed = pushed_filters(m.purchase_attempts)
    assert any("EqualTo(event_type,purchase)" in f for f in pushed)


def test_request_summary(spark):
    from rosterlake.operators import documents
    logs = spark.createDataFrame([
        ('{"method": "GET", "path": "/a", "status": 200, "ms": 10}',),
        ('{"method": "GET", "path": "/a", "status": 503, "ms": 30}',),
        ('{"method": "POST", "path": "/b", "status": 201, "ms": 5}',),
        ('not json',)], "extra string")
    got = {(r.method, r.path): (r.richieste, r.errori, r.ms_medio) for r in documents.request_summary(logs).collect()}
    assert got == {("GET", "/a"): (2, 1, 20.0), ("POST", "/b"): (1, 0, 5.0), (None, None): (1, 0, None)}


def test_start_scoreboard_and_admission(spark, tmp_path):
    m = LeagueModel(spark, SF_SMALL)
    src = tmp_path / "asta"
    m.asta_log.write.parquet(str(src))
    stream = spark.readStream.schema(m.asta_log.schema).parquet(str(src))
    feeds.start_scoreboard(stream, m.squadre, str(tmp_path / "board"), str(tmp_path / "ckb"),
                           available_now=True).awaitTermination(120)
    board = spark.read.parquet(str(tmp_path / "board"))
    assert board.select("batch").distinct().count() >= 1
    from rosterlake.streaming.admission import start_admission
    att = tmp_path / "att"
    m.purchase_attempts.write.parquet(str(att))
    s = spark.readStream.schema(m.purchase_attempts.schema).parquet(str(att))
    start_admission(s, m.auction_census, m.giocatori, str(tmp_path / "judged"), str(tmp_path / "cka"),
                    available_now=True).awaitTermination(180)
    judged = spark.read.parquet(str(tmp_path / "judged"))
    want = auction.purchase_admission(m.purchase_attempts, m.auction_census, m.giocatori)
    key = ["id", "accepted", "reason", "residuo_prima"]
    assert sorted(map(tuple, judged.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
