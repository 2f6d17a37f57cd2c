"""Purchase admission (X9), its appends (I1, I2) and the streaming form."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.operators import auction
from rosterlake.streaming.admission import admission_stream

T0 = dt.datetime(2024, 1, 1)
ATTEMPT_DDL = ("ts timestamp_ntz, id long, giocatore_id long, prezzo_finale double, "
               "squadra_acquirente string, e_mio boolean, fonte string")


def _attempts(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=i), i, g, p, team, mine, "manuale")
         for i, (g, p, team, mine) in enumerate(rows)], ATTEMPT_DDL)


def _census(spark, teams):
    return spark.createDataFrame([(n, None, b) for n, b in teams], "nome string, allenatore string, budget_totale double")


def _players(spark, ids):
    return spark.createDataFrame([(i, "P") for i in ids], "id long, ruolo string")


def _judge(spark, rows, teams, players):
    out = auction.purchase_admission(_attempts(spark, rows), _census(spark, teams), _players(spark, players))
    return [tuple(r) for r in out.orderBy("id").select("accepted", "reason", "residuo_prima").collect()]


def test_fixture_sequence(spark):
    rows = [(1, 50.0, "A", False), (2, 60.0, "A", False), (3, 40.0, "A", False),
            (4, 10.0, "A", False), (5, 1.0, "A", False), (6, 5.0, "Z", False), (99, 1.0, "B", False)]
    got = _judge(spark, rows, [("A", 100.0), ("B", 100.0)], [1, 2, 3, 4, 5, 6])
    assert got == [
        (True, None, 100.0),
        (False, "budget_insufficiente", 50.0),
        (True, None, 50.0),
        (True, None, 10.0),          # equal to the residual passes
        (False, "budget_insufficiente", 0.0),
        (False, "squadra_non_censita", None),
        (False, "giocatore_non_trovato", 100.0),  # unknown player: nothing spent
    ]


def _python_fold(rows, budgets, players):
    spent, out = {}, []
    for g, p, team, _ in rows:
        if team not in budgets:
            out.append((False, "squadra_non_censita", None))
            continue
        res = budgets[team] - spent.get(team, 0.0)
        if p > res:
            out.append((False, "budget_insufficiente", res))
        elif g not in players:
            out.append((False, "giocatore_non_trovato", res))
        else:
            spent[team] = spent.get(team, 0.0) + p
            out.append((True, None, res))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 60), st.sampled_from("ABCX"), st.booleans()),
                min_size=1, max_size=40))
def test_matches_python_loop(spark, rows):
    rows = [(g, float(p), t, m) for g, p, t, m in rows]
    budgets = {"A": 100.0, "B": 60.0, "C": 250.0}
    players = {0, 1, 2, 3, 4, 5}
    assert _judge(spark, rows, list(budgets.items()), sorted(players)) == _python_fold(rows, budgets, players)


def test_appends(spark):
    rows = [(1, 50.0, "A", True), (2, 70.0, "A", True), (3, 20.0, "A", False)]
    judged = auction.purchase_admission(_attempts(spark, rows), _census(spark, [("A", 100.0)]),
                                        _players(spark, [1, 2, 3]))
    assert sorted(r.giocatore_id for r in auction.accepted_purchases(judged).collect()) == [1, 3]
    mine = auction.my_new_players(judged, _players(spark, [1, 2, 3])).collect()
    assert [(r.giocatore_id, r.ruolo_fanta) for r in mine] == [(1, "P")]


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 5), float(rnd.randint(1, 40)), rnd.choice("ABC"), False) for _ in range(60)]
    census = _census(spark, [("A", 100.0), ("B", 150.0)])
    players = _players(spark, [0, 1, 2, 3, 4])
    src = tmp_path / "attempts"
    df = _attempts(spark, rows)
    # three files in arrival (ts) order, one per micro-batch
    for k in range(3):
        df.where(f"id >= {k * 20} and id < {(k + 1) * 20}").coalesce(1).write.parquet(str(src / f"part{k}"))
    stream = (spark.readStream.schema(ATTEMPT_DDL).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    q = (admission_stream(stream, census, players).writeStream.format("memory")
         .queryName("admission_t1").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql(
        "select accepted, reason, residuo_prima from admission_t1 order by id").collect()]
    want = _judge(spark, rows, [("A", 100.0), ("B", 150.0)], [0, 1, 2, 3, 4])
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-300, 9000), st.sampled_from("ABX"), st.booleans()),
                min_size=1, max_size=80))
def test_result_does_not_depend_on_the_blocks(spark, rows):
    rows = [(g, p / 100, t, m) for g, p, t, m in rows]   # prices in cents
    census = _census(spark, [("A", 100.0), ("B", 37.5)])
    players = _players(spark, [0, 1, 2, 3, 4, 5])
    att = _attempts(spark, rows)
    cols = ["accepted", "reason", "residuo_prima"]
    want = _python_fold_cents(rows, {"A": 100.0, "B": 37.5}, {0, 1, 2, 3, 4, 5})
    for block_rows in (1, 3, auction.BLOCK_ROWS):
        out = auction.purchase_admission(att, census, players, block_rows=block_rows)
        assert [tuple(r) for r in out.orderBy("id").select(*cols).collect()] == want


def _python_fold_cents(rows, budgets, players):
    spent, out = {}, []
    for g, p, team, _ in rows:
        if team not in budgets:
            out.append((False, "squadra_non_censita", None))
            continue
        res = round(budgets[team] * 100) - spent.get(team, 0)
        pc = round(p * 100)
        if pc > res:
            out.append((False, "budget_insufficiente", res / 100))
        elif g not in players:
            out.append((False, "giocatore_non_trovato", res / 100))
        else:
            spent[team] = spent.get(team, 0) + pc
            out.append((True, None, res / 100))
    return out


def test_candidates_hold_every_payable_price(spark):
    """The bound of a block: whatever the residual at its start, what is accepted is a candidate."""
    from pyspark.sql import functions as F
    rnd = random.Random(3)
    cases = [[(rnd.randint(-20, 300), rnd.random() < .9) for _ in range(rnd.randint(1, 30))] for _ in range(40)]
    ceiling = 1000
    df = spark.createDataFrame([(k, [{"_price_c": p, "_pays": ok} for p, ok in c]) for k, c in enumerate(cases)],
                               "k long, rows array<struct<_price_c:long,_pays:boolean>>")
    got = {r.k: r.c for r in df.select("k", auction._candidates(F.col("rows"), F.lit(ceiling).cast("long")).alias("c")).collect()}
    fewer = 0
    for k, case in enumerate(cases):
        left, at = list(got[k]), 0
        fewer += len(left) < sum(ok for _, ok in case)
        for start in range(-5, ceiling + 1, 7):
            residual, rest = start, start
            taken = []
            for p, ok in case:
                if ok and p <= residual:
                    residual -= p
                    taken.append(p)
            short = []
            for p in left:                       # folding the candidates alone gives the same purchases
                if p <= rest:
                    rest -= p
                    short.append(p)
            assert short == taken
    assert fewer > 10


def test_team_with_half_of_all_rows_equals_the_loop(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 6), rnd.randint(1, 4000) / 100, "A" if rnd.random() < .5 else rnd.choice("BCDE"), False) for _ in range(3000)]
    budgets = {"A": 180.0, "B": 90.0, "C": 1e6, "D": 0.0}
    out = auction.purchase_admission(_attempts(spark, rows).repartition(7), _census(spark, list(budgets.items())),
                                     _players(spark, [0, 1, 2, 3, 4, 5]), block_rows=16)
    got = [tuple(r) for r in out.orderBy("id").select("accepted", "reason", "residuo_prima").collect()]
    assert got == _python_fold_cents(rows, budgets, {0, 1, 2, 3, 4, 5})
    assert sum(a for a, _, _ in got) > 300


def test_null_team_and_repeated_attempts(spark):
    when = T0
    rows = [(when, 1, 1, 10.0, None, False, "x"), (when, 1, 1, 10.0, "A", False, "x"), (when, 1, 1, 10.0, "A", False, "x"), (None, 2, 1, 95.0, "A", False, "x")]
    out = auction.purchase_admission(spark.createDataFrame(rows, ATTEMPT_DDL), _census(spark, [("A", 100.0)]), _players(spark, [1]), block_rows=1)
    got = sorted((r.squadra_acquirente or "", r.prezzo_finale, r.accepted, r.residuo_prima or -1.0) for r in out.collect())
    # no time comes first; then both copies of one attempt are too dear
    assert got == [("", 10.0, False, -1.0), ("A", 10.0, False, 5.0), ("A", 10.0, False, 5.0), ("A", 95.0, True, 100.0)]


def test_null_price_and_null_budget_are_rejected_and_spend_nothing(spark):
    rows = [(0, 1, 1, None, "A"), (1, 2, 1, 60.0, "A"), (2, 3, 1, 10.0, "B"), (3, 4, 1, 50.0, "A")]
    att = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), i, g, p, t, False, "x") for s, i, g, p, t in rows],
                                "ts timestamp_ntz, id long, giocatore_id long, prezzo_finale double, "
                                "squadra_acquirente string, e_mio boolean, fonte string")
    census = spark.createDataFrame([("A", 100.0), ("B", None)], "nome string, budget_totale double")
    out = {r.id: (r.accepted, r.reason) for r in auction.purchase_admission(att, census, _players(spark, [1])).collect()}
    assert out == {1: (False, auction.REASON_PRICE), 2: (True, None), 3: (False, auction.REASON_NO_BUDGET),
                   4: (False, auction.REASON_BUDGET)}


def _run_stream(spark, src, census, players, out, ckpt, ledger):
    from rosterlake.streaming.admission import start_admission
    stream = spark.readStream.schema(ATTEMPT_DDL).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    start_admission(stream, census, players, str(out), str(ckpt), available_now=True, ledger=ledger).awaitTermination(240)
    cols = ["id", "accepted", "reason", "residuo_prima"]
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).select(*cols).collect())


def test_restarted_stream_with_ledger_equals_one_batch(spark, tmp_path):
    """The ledger counts once, also when the stream's own purchases are in it at the
    restart; late rows are judged as they come."""
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 5), float(rnd.randint(1, 40)), rnd.choice("ABC"), False) for _ in range(60)]
    att, census, players = _attempts(spark, rows), _census(spark, [("A", 300.0), ("B", 150.0)]), _players(spark, [0, 1, 2, 3, 4])
    ledger = spark.createDataFrame([("A", 120.0), ("A", 30.0), ("Z", 5.0), (None, 9.0)], "squadra_acquirente string, prezzo_finale double")
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    att.where("id < 30").coalesce(1).write.parquet(str(src / "a"))
    first = _run_stream(spark, src, census, players, out, ckpt, ledger)
    assert len(first) == 30
    own = spark.read.parquet(str(out)).where("accepted").select("squadra_acquirente", "prezzo_finale")
    grown = spark.createDataFrame([tuple(r) for r in ledger.unionByName(own).collect()], ledger.schema)
    att.where("id >= 30").coalesce(1).write.parquet(str(src / "b"))
    got = _run_stream(spark, src, census, players, out, ckpt, grown)
    want = auction.purchase_admission(att, census, players, ledger=ledger)
    assert got == sorted(tuple(r) for r in want.select("id", "accepted", "reason", "residuo_prima").collect())
    # a late attempt (before all others by its time) is judged on what is left now
    late = spark.createDataFrame([(T0 - dt.timedelta(days=1), 1000, 1, 1e-2, "A", False, "x")], ATTEMPT_DDL)
    late.coalesce(1).write.parquet(str(src / "c"))
    after = dict((r[0], r) for r in _run_stream(spark, src, census, players, out, ckpt, grown))
    spent = sum(r.prezzo_finale for r in want.where("accepted and squadra_acquirente = 'A'").collect())
    assert round(after[1000][3], 2) == round(150.0 - spent, 2)


def test_two_batches_with_the_ledger_judge_as_one(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), s + 1, 1, p, "A", False, "x") for s, p in enumerate((60.0, 50.0, 30.0, 20.0, 10.0))]
    kinds = ("ts timestamp_ntz, id long, giocatore_id long, prezzo_finale double, "
             "squadra_acquirente string, e_mio boolean, fonte string")
    census = spark.createDataFrame([("A", 100.0)], "nome string, budget_totale double")
    judge = lambda r, ledger=None: auction.purchase_admission(
        spark.createDataFrame(r, kinds), census, _players(spark, [1]), ledger=ledger)
    whole = {r.id: r.accepted for r in judge(rows).collect()}
    first = judge(rows[:2])
    second = judge(rows[2:], auction.accepted_purchases(first))
    assert {r.id: r.accepted for r in [*first.collect(), *second.collect()]} == whole
