"""One-scan sheets (S2-S4, Q19), numbered merges (M3, M9, M13) and answers."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import etl, merge
from rosterlake.plans.checks import physical_plan
from rosterlake.sources import answers, sheets

HEADER = "Id,R,Nome,Squadra,Qt.A,Qt.I,FVM"


def test_sheets_are_scanned_once_in_file_order(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.csv", "b.csv", "c.csv"))
    a.write_text("Listone A\n" + HEADER + '\n1,P,"Ros,si",Inter,10,9,30\n\n2,D,Verdi,,5,5,\n2,D,"Due\nrighe",Roma,5,5,7\n')
    b.write_text("﻿Listone B,,\nNome,Id,Squadra,R,FVM,Qt.I,Qt.A,Extra\nBianchi,3,Milan,D,40,7,8,x\n")
    c.write_text("niente\n")
    paths = [str(b), str(a), str(c)]
    df = sheets.scan_sheets(spark, paths, etl.PRICE_LIST_REQUIRED, ("Extra",))
    assert physical_plan(df).count("FileScan") == 1 and "Exchange" not in physical_plan(df)
    rows = sorted(df.collect(), key=lambda r: tuple(r._ordinal))
    assert [(r.Id, r.Nome, r.Squadra, r.FVM, r.Extra, r._title) for r in rows] == [
        ("3", "Bianchi", "Milan", "40", "x", "Listone B"), ("1", "Ros,si", "Inter", "30", None, "Listone A"),
        ("2", "Verdi", None, None, None, "Listone A"), ("2", "Due\nrighe", "Roma", "7", None, "Listone A")]
    assert [r._ordinal.file for r in rows] == [0, 1, 1, 1]
    assert df.select("Id", "_title").exceptAll(sheets.read_sheets(spark, paths[:1], etl.PRICE_LIST_REQUIRED).select("Id", "_title")).count() == 3
    with pytest.raises(Exception, match="missing columns in .*a.csv.*Pv"):
        sheets.scan_sheets(spark, str(a), etl.STATS_REQUIRED).collect()


def _merged(target: dict, source: list[tuple], start: int) -> dict:
    """key -> (id, value, action) by a loop; ids of new keys in key order."""
    last = {k: v for k, v in source}
    out = {k: (i, last.get(k, v), "aggiornato" if k in last else "invariato") for k, (i, v) in target.items()}
    for n, k in enumerate(sorted(k for k in last if k not in target), start + 1):
        out[k] = (n, last[k], "inserito")
    return out


@pytest.mark.parametrize("parts", ["1", "5", "13"])
def test_numbered_merge_against_a_loop(spark, parts):
    rnd = random.Random(4)
    target = {k: (i, rnd.randrange(9)) for i, k in enumerate(rnd.sample(range(200), 80), 1)}
    source = [(rnd.randrange(260), rnd.randrange(9)) for _ in range(150)]
    t = spark.createDataFrame([(i, k, v) for k, (i, v) in target.items()], "id long, k long, v long")
    s = spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(source)], "k long, v long, o long").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = merge.merge_numbered(t, merge.dedupe_last_wins(s, ["k"], "o").drop("o"), ["k"], ["v"])
        got = {r.k: (r.id, r.v, r.azione) for r in out.collect()}
        plan = physical_plan(out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == _merged(target, source, 80) and out.count() == len(got)
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 4


def test_numbered_merge_keeps_null_keys_apart(spark):
    t = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (3, None, "c")], "id long, k long, v string")
    s = spark.createDataFrame([(None, "x"), (None, "x"), (5, "y"), (6, "z")], "k long, v string")
    got = sorted((r.id, r.k, r.v, r.azione) for r in merge.merge_numbered(t, s, ["k"], ["v"]).collect())
    assert [g for g in got if g[0] <= 3] == [(1, None, "a", "invariato"), (2, 5, "y", "aggiornato"), (3, None, "c", "invariato")]
    assert sorted(g[0] for g in got if g[0] > 3) == [4, 5, 6] and {g[1:] for g in got if g[0] > 3} == {(None, "x", "inserito"), (6, "z", "inserito")}
    empty = t.limit(0)
    assert [(r.id, r.azione) for r in merge.merge_numbered(empty, s.where("k = 6"), ["k"], ["v"]).collect()] == [(1, "inserito")]
    assert merge.merge_numbered(t, s.limit(0), ["k"], ["v"]).where("azione <> 'invariato'").count() == 0


def test_strict_merge_refuses_repeated_keys(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "k long, v string")
    assert merge.unique_keys(s, ["k"]).count() == 4
    with pytest.raises(Exception, match="repeated merge key .*1"):
        merge.unique_keys(s.unionByName(s.where("k = 1")), ["k"]).collect()


def test_answers_of_all_kinds(spark):
    rows = [("a", "asta", '{"acquisti": [{"nome": "X", "prezzo_finale": 5, "squadra_acquirente": "T"}, {"nome": "Y", "prezzo_finale": "molto"}]}'),
            ("b", "formazione", '{"modulo": "3-4-3", "titolari": ["P", "Q"]}'), ("c", "listone", '{"giocatori": []}'),
            ("d", "listone", "Certo! Ecco i giocatori:"), ("e", "asta", '{"k": 1}'), ("f", "asta", None), ("g", "listone", '{"giocatori": [{"nome": "Z", "ruolo": "P"}]}'),
            ("h", "formazione", '{"modulo": 4, "titolari": "nessuno"}')]
    df = spark.createDataFrame(rows, "answer_id string, kind string, raw_response string")
    got = {r.answer_id: tuple(r)[2:] for r in answers.parse_all(df).collect()}
    assert got == {"a": (True, None, 2, None), "b": (True, "3-4-3", 2, None), "c": (True, None, 0, None),
                   "d": (False, None, None, "Certo! Ecco i giocatori:"), "e": (True, None, None, None), "f": (False, None, None, None),
                   "g": (True, None, 1, None), "h": (True, "4", None, None)}
    flat = sorted((tuple(r) for r in answers.flatten_all(answers.parse_answers(df)).collect()), key=repr)
    assert ("a", "asta", 0, "X", None, None, 5.0, "T") in flat and ("a", "asta", 1, "Y", None, None, None, None) in flat
    assert ("b", "formazione", 1, "Q", None, None, None, None) in flat and ("c", "listone", None, None, None, None, None, None) in flat
    assert len(flat) == 10
    one = answers.flatten_answers(answers.parse_answers(df.where(F.col("kind") == "formazione"), "formazione"), "formazione")
    assert {(r.answer_id, r.titolare) for r in one.collect()} == {("b", "P"), ("b", "Q"), ("h", None)}
