"""End-to-end ETL jobs over sheet files."""

import datetime as dt

import pytest

from rosterlake import jobs
from rosterlake.schemas import schema_of

PRICE_HEADER = "Id,R,RM,Nome,Squadra,Qt.A,Qt.I,Diff.,Qt.A M,Qt.I M,Diff.M,FVM,FVM M"
STATS_HEADER = "Id,R,Rm,Nome,Squadra,Pv,Mv,Fm,Gf,Gs,Rp,Rc,R+,R-,Ass,Amm,Esp,Au"


def _players(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 10, "Rossi", "P", "Inter", 5.0, 5.0, 20.0, t, t),
            (2, 20, "Verdi", "D", "Milan", 6.0, 6.0, 30.0, t, t),
            (3, None, "Manuale", "C", "Roma", 1.0, 1.0, None, t, t)]
    return spark.createDataFrame(rows, schema_of("giocatori"))


def test_import_price_list_with_sync_and_cascade(spark, tmp_path):
    sheet = tmp_path / "listone.csv"
    sheet.write_text(
        "Quotazioni Fantacalcio Stagione 2025 26\n" + PRICE_HEADER + "\n"
        "10,P,Por,  Rossi ,Inter,12,11,1,0,0,0,33,0\n"
        "30,A,Pc,Nuovo,Roma,9,9,0,0,0,0,20,0\n"
        "31,A,Pc,,Roma,9,9,0,0,0,0,20,0\n"
        "30,A,Pc,Nuovo Bis,Roma,10,9,0,0,0,0,21,0\n")
    stats = spark.createDataFrame([(1, 1, "2024/25", 3), (2, 2, "2024/25", 4), (3, None, "2024/25", 5)],
                                  "id long, giocatore_id long, stagione string, presenze int")
    now = dt.datetime(2025, 8, 1)
    report = jobs.import_price_list(
        spark, str(sheet), _players(spark), str(tmp_path / "giocatori_v2"), budget_lega=500, sync=True,
        children={"statistiche_storiche": stats},
        children_out={"statistiche_storiche": str(tmp_path / "stats_v2")}, now=now)
    rep = {r.voce: r.n for r in report.collect()}
    assert rep == {"aggiornato": 1, "inserito": 1, "invariato": 2, "rimosso": 1}
    got = {r.fanta_id: r for r in spark.read.parquet(str(tmp_path / "giocatori_v2")).collect()}
    assert set(got) == {10, 30, None}                     # Verdi removed, NULL fanta_id kept
    assert got[10].nome == "Rossi" and got[10].quotazione_attuale == 12.0 and got[10].fvm == 17.0
    assert got[10].aggiornato_il == now and got[10].creato_il == dt.datetime(2024, 1, 1)
    assert got[30].nome == "Nuovo Bis" and got[30].id == 4  # last wins, next id
    kept = sorted(r.presenze for r in spark.read.parquet(str(tmp_path / "stats_v2")).collect())
    assert kept == [3, 5]                                  # Verdi's row cascaded away, NULL fk kept


def test_import_price_list_refuses_empty_sync(spark, tmp_path):
    sheet = tmp_path / "vuoto.csv"
    sheet.write_text("Quotazioni\n" + PRICE_HEADER + "\n")
    with pytest.raises(ValueError, match="empty"):
        jobs.import_price_list(spark, str(sheet), _players(spark), str(tmp_path / "g"), sync=True)


def test_import_season_stats_rewrites_only_imported_seasons(spark, tmp_path):
    players = _players(spark)
    stats_cols = schema_of("statistiche_storiche")
    from pyspark.sql import functions as F
    old = spark.createDataFrame([(1, 1, "2023/24", 30), (2, 2, "2024/25", 10)],
                                "id long, giocatore_id long, stagione string, presenze int")
    for f in stats_cols.fields:
        if f.name not in old.columns:
            old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
    old = old.select(*[f.name for f in stats_cols.fields])
    out = str(tmp_path / "stats")
    old.write.partitionBy("stagione").parquet(out)
    sheet = tmp_path / "Statistiche_2024_25.csv"
    sheet.write_text("Statistiche\n" + STATS_HEADER + "\n"
                     "20,D,Dc,Verdi,Milan,12,6,6.5,0,0,0,0,0,0,1,0,0,0\n"
                     "10,P,Por,Rossi,Inter,31,6.2,5.5,0,22,0,0,0,0,0,0,0,0\n"
                     "99,A,Pc,Ignoto,Roma,5,6,6,1,0,0,0,0,0,0,0,0,0\n")
    source = str(tmp_path / "read")
    old.write.parquet(source)
    complete = {(1, "2023/24"): 30, (2, "2024/25"): 12, (1, "2024/25"): 31}
    rows = lambda path: {(r.giocatore_id, r.stagione): r.presenze for r in spark.read.parquet(path).collect()}
    report = {"aggiornato": 1, "inserito": 1, "saltato": 1}

    new = str(tmp_path / "stats_v2")                         # a complete snapshot at a new place
    rep = jobs.import_season_stats(spark, str(sheet), players, spark.read.parquet(source), new)
    assert rows(new) == complete
    ids = {(r.giocatore_id, r.stagione): r.id for r in spark.read.parquet(new).collect()}
    assert ids == {(1, "2023/24"): 1, (2, "2024/25"): 2, (1, "2024/25"): 3}
    # the report was counted while the rows were written: it stays when the input changes
    spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(source)
    assert {r.voce: r.n for r in rep.collect()} == report

    old.write.mode("overwrite").parquet(source)              # in place: only the imported season is rewritten
    before = sorted(p.name for p in (tmp_path / "stats" / "stagione=2023%2F24").iterdir())
    rep = jobs.import_season_stats(spark, str(sheet), players, spark.read.parquet(source), out, in_place=True)
    assert {r.voce: r.n for r in rep.collect()} == report and rows(out) == complete
    assert before == sorted(p.name for p in (tmp_path / "stats" / "stagione=2023%2F24").iterdir())


def test_price_list_rejects_and_strict_mode(spark, tmp_path):
    sheet = tmp_path / "listone.csv"
    sheet.write_text("Listone\n" + PRICE_HEADER + "\n10,P,Por,Rossi,Inter,12,11,1,0,0,0,33,0\n40,P,Por,Rotto,Inter,molti,11,1,0,0,0,33,0\n")
    rep = jobs.import_price_list(spark, str(sheet), _players(spark), str(tmp_path / "v2"))
    assert {r.voce: r.n for r in rep.collect()} == {"aggiornato": 1, "invariato": 2, "scartato": 1}
    assert spark.read.parquet(str(tmp_path / "v2")).where("nome = 'Rotto'").count() == 0
    twice = tmp_path / "doppio.csv"
    twice.write_text("Listone\n" + PRICE_HEADER + "\n10,P,Por,Rossi,Inter,12,11,1,0,0,0,33,0\n10,P,Por,Rossi,Inter,13,11,1,0,0,0,33,0\n")
    with pytest.raises(Exception, match="repeated merge key"):
        jobs.import_price_list(spark, str(twice), _players(spark), str(tmp_path / "v3"), strict=True)
    jobs.import_price_list(spark, str(twice), _players(spark), str(tmp_path / "v4"))
    assert spark.read.parquet(str(tmp_path / "v4")).where("fanta_id = 10").first().quotazione_attuale == 13.0
