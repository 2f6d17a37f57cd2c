"""ETL parsing (S1-S4, X23, X24, F4, F10, F11) and search rules."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up, safe_double, safe_int
from rosterlake.operators import etl, search
from rosterlake.sources import sheets


def test_season_from_title_and_file(spark):
    rows = [("Statistiche Fantacalcio Stagione 2024 25", "/x/a.csv", "2024/25"),
            ("Stagione 2024 2025", "/x/a.csv", "2024/25"),
            ("Statistiche", "/x/Statistiche_2023_24.csv", "2023/24"),
            ("Statistiche", "/x/nothing.csv", None)]
    df = spark.createDataFrame([(t, p) for t, p, _ in rows], "t string, p string")
    got = [r[0] for r in df.select(etl.season_from(F.col("t"), F.col("p"))).collect()]
    assert got == [e for _, _, e in rows]


def test_safe_casts(spark):
    df = spark.createDataFrame([("3",), ("3.5",), ("abc",), (None,), ("nan",), ("6,5",)], "v string")
    got = [(r[0], r[1]) for r in df.select(safe_int(F.col("v")), safe_double(F.col("v"))).collect()]
    assert got == [(3, 3.0), (0, 3.5), (0, None), (0, None), (0, None), (0, None)]
    d = spark.createDataFrame([(3.9,)], "v double")
    assert d.select(safe_int(F.col("v"))).first()[0] == 3


def test_rounding_half_up(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()] == [2.68, 0.13, 1.01]


def test_price_list_transform(spark):
    raw = spark.createDataFrame(
        [("1", " P ", "  Rossi ", "Inter", "10", "9", "33"), ("2", "D", None, "Milan", "5", "5", "10"),
         ("3", "C", "Bianchi", "Roma", "7", "7", "100")],
        "Id string, R string, Nome string, Squadra string, `Qt.A` string, `Qt.I` string, FVM string")
    out = {r.fanta_id: r for r in etl.price_list_transform(raw, 500).collect()}
    assert set(out) == {1, 3}                       # NULL Nome skipped
    assert (out[1].nome, out[1].ruolo, out[1].fvm) == ("Rossi", "P", 17.0)   # ceil(16.5)
    big = {r.fanta_id: r.fvm for r in etl.price_list_transform(raw, 1100).collect()}
    assert big[3] == 111.0                          # 100 x 1.1 = 110.00000000000001 -> 111


def test_sheet_scan_and_stats_transform(spark, tmp_path):
    header = "Id,R,Rm,Nome,Squadra,Pv,Mv,Fm,Gf,Gs,Rp,Rc,R+,R-,Ass,Amm,Esp,Au"
    (tmp_path / "a.csv").write_text(
        "Statistiche Fantacalcio Stagione 2024 25\n" + header + "\n"
        "1,P,Por,Rossi,Inter,30,6.1,5.9,0,20,1,0,0,0,0,2,0,0\n"
        "2,D,Dc,Verdi,Milan,abc,nan,6.5,1,0,0,0,1,0,3.5,1,0,0\n"
        "9,A,Pc,Nuovo,Roma,10,6,7,4,0,0,1,4,0,1,0,0,0\n"
        ",C,C,Vuoto,Roma,,,,,,,,,,,,,\n")
    (tmp_path / "Statistiche_2023_24.csv").write_text(
        "Statistiche\n" + header + "\n1,P,Por,Rossi,Inter,28,6,5.5,0,25,0,0,0,0,0,1,0,0\n")
    raw = sheets.read_sheets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "Statistiche_2023_24.csv")],
                             etl.STATS_REQUIRED)
    players = spark.createDataFrame([(100, 1), (200, 2)], "id long, fanta_id long")
    out = etl.season_stats_transform(raw, players, etl.season_from(F.col("_title"), F.col("_path")))
    got = {(r.fanta_id, r.stagione): r for r in out.collect()}
    assert got[(1, "2024/25")].giocatore_id == 100 and got[(1, "2023/24")].presenze == 28
    assert got[(2, "2024/25")].presenze == 0 and got[(2, "2024/25")].media_voto is None
    assert got[(2, "2024/25")].assist == 0 and got[(2, "2024/25")].fantamedia == 6.5
    assert got[(9, "2024/25")].esito == "saltato"
    assert got[(None, "2024/25")].esito == "incompleto"
    with pytest.raises(ValueError, match="FVM"):
        sheets.read_sheets(spark, [str(tmp_path / "a.csv")], etl.PRICE_LIST_REQUIRED)


def test_price_csv_last_wins(spark, tmp_path):
    from rosterlake.operators import merge
    p = tmp_path / "prezzi.csv"
    p.write_text("nome,ruolo,squadra,quotazione\nRossi,P,Inter,10\nRossi,P,Inter,12\nBianchi,D,Roma,5\n")
    df = sheets.read_price_csv(spark, str(p))
    d = {(r.nome, r.quotazione) for r in merge.dedupe_last_wins(df, ["nome", "squadra"], "_ordinal").collect()}
    assert d == {("Rossi", 12.0), ("Bianchi", 5.0)}


def _players(spark):
    rows = [(1, "Ab_c", "P", "Inter", 5.0, 35.0), (2, "Abxc", "D", "Milan", 6.0, None),
            (3, "100%", "C", "Inter B", 7.0, 50.0), (4, "zeta", "A", "Roma", 8.0, 40.0)]
    return spark.createDataFrame(rows, "id long, nome string, ruolo string, squadra string, "
                                       "quotazione_attuale double, fvm double") \
        .withColumn("quotazione_iniziale", F.col("quotazione_attuale"))


def test_name_search_wildcards_and_escape(spark):
    g = _players(spark)
    assert [r.id for r in search.name_search(g, "b_c").collect()] == [1, 2]   # _ is a wildcard
    assert [r.id for r in search.name_search(g, "b_c", escape=True).collect()] == [1]
    with pytest.raises(ValueError):
        search.name_search(g, "a")


def test_structured_search_limits_and_whitelist(spark):
    g = _players(spark)
    asta = spark.createDataFrame([(4,), (None,)], "giocatore_id long")
    res = search.structured_search(g, asta, order_by="not_a_column", limit=0)
    assert [r.nome for r in res.collect()] == ["100%", "Ab_c", "Abxc"]  # fvm desc, NULL last; 4 is sold
    assert search.capped_limit(None) == 10 if hasattr(search, "capped_limit") else True
    from rosterlake.operators.common import capped_limit
    assert (capped_limit(0), capped_limit(None), capped_limit(51), capped_limit(7)) == (10, 10, 50, 7)
    nb = search.structured_search(g, asta, squadra="inter", escludi_squadra=" B", solo_liberi=False)
    assert [r.nome for r in nb.collect()] == ["Ab_c"]


def test_team_roster_words(spark):
    g = _players(spark)
    asta = spark.createDataFrame([(10, 1, 5.0, "Lupi"), (11, 3, 9.0, "Orsi")],
                                 "id long, giocatore_id long, prezzo_finale double, squadra_acquirente string")
    sq = spark.createDataFrame([("Lupi", "Mario"), ("Orsi", None)], "nome string, allenatore string")
    assert search.team_roster(asta, g, sq, "   ").count() == 0
    assert [r.nome for r in search.team_roster(asta, g, sq, "mar xyz").collect()] == ["Ab_c"]
    assert search.team_roster(asta, g, sq, "orsi lupi").count() == 2


def test_sheets_with_different_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Listone A\nId,R,Nome,Squadra,Qt.A,Qt.I,FVM\n1,P,Rossi,Inter,10,9,30\n")
    (tmp_path / "b.csv").write_text("Listone B\nNome,Id,Squadra,R,FVM,Qt.I,Qt.A,Extra\nVerdi,2,Milan,D,40,7,8,x\n")
    raw = sheets.read_sheets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], etl.PRICE_LIST_REQUIRED)
    got = {r.fanta_id: (r.nome, r.ruolo, r.quotazione_attuale, r.fvm)
           for r in etl.price_list_transform(raw).collect()}
    assert got == {1: ("Rossi", "P", 10.0, 30.0), 2: ("Verdi", "D", 8.0, 40.0)}
    titles = {r._title for r in raw.select("_title").collect()}
    assert titles == {"Listone A", "Listone B"}


def test_rows_know_their_file_whatever_its_name(spark, tmp_path):
    row = "nome,ruolo,squadra,quotazione\n{},P,Inter,{}\n"
    for k, name in enumerate(("list2", "list", "a b")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(row.format(name, k))
    for prefix in ("", "file:", "file://"):
        paths = [f"{prefix}{tmp_path}/{name}" for name in ("list2", "list", "a b")]
        got = {r.nome: r._ordinal.file for r in sheets.read_price_csv(spark, paths).collect()}
        assert got == {"list2": 0, "list": 1, "a b": 2}
        got = {r.nome: r._ordinal.file for r in sheets.read_price_csv(spark, paths[1::-1]).collect()}
        assert got == {"list": 0, "list2": 1}
