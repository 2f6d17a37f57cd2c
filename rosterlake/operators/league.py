"""League table, round top/flop, team budgets and my roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up


def league_table(asta_log: DataFrame, voti: DataFrame) -> DataFrame:
    """Points per buying team: distinct rounds, total and mean fantavoto.

    Every purchase counts (a player sold twice scores for both buyers, and twice
    for a team that bought him twice). Both sides are collapsed before the join:
    purchases to ``(player, team, n)``, grades to one row per player with their sum,
    their count and the rounds as bits of a long (a round is 1 to 38 by its CHECK; one
    outside 0 to 62 fails the query). A team's rounds are then the bits of the ``or``.
    """
    buys = (asta_log.where(F.col("giocatore_id").isNotNull())
            .groupBy("giocatore_id", "squadra_acquirente")
            .agg(F.count(F.lit(1)).alias("n")))
    bit = (F.when(F.col("giornata").between(0, 62), F.expr("shiftleft(1L, giornata)"))
           .when(F.col("giornata").isNotNull(), F.raise_error(F.lit("giornata outside 0 to 62")).cast("long")))
    grades = voti.groupBy("giocatore_id").agg(
        F.sum("fantavoto").alias("_s"), F.count("fantavoto").alias("_c"), F.bit_or(bit).alias("_rounds"))
    n = F.col("n")
    out = buys.join(grades, "giocatore_id").groupBy(F.col("squadra_acquirente").alias("squadra")).agg(
        F.coalesce(F.bit_count(F.bit_or("_rounds")), F.lit(0)).cast("long").alias("giornate_giocate"),
        F.sum(F.col("_s") * n).alias("_sum"),
        F.sum(F.col("_c") * n).alias("_cnt"),
    )
    return out.select(
        "squadra", "giornate_giocate",
        round_half_up(F.col("_sum"), 1).alias("punti_totali"),
        round_half_up(F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt")), 2).alias("fantamedia_squadra"),
    ).orderBy(F.col("punti_totali").desc_nulls_last(), F.col("squadra"))


def _round_rows(voti: DataFrame, giocatori: DataFrame, asta_log: DataFrame, numero: int, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of the round by ``order``, then grade and sale id. A grade
    gives one row at least, so only the first ``limit`` grades can be among them:
    they are cut before the join with the purchases."""
    vg = voti.where(F.col("giornata") == numero).select(
        F.col("id").alias("voto_id"), "giocatore_id", "voto", "fantavoto", "gol", "assist",
        "ammonizione", "espulsione")
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    a = asta_log.select(F.col("giocatore_id").alias("aid"), F.col("id").alias("asta_id"),
                        F.col("squadra_acquirente").alias("squadra_fanta"))
    first = vg.join(g, vg.giocatore_id == g.gid).orderBy(*order, F.col("voto_id").asc()).limit(limit)
    return (first.join(a, first.giocatore_id == a.aid, "left")
            .orderBy(*order, F.col("voto_id").asc(), F.col("asta_id").asc_nulls_first()).limit(limit))


_ROUND_COLS = ["nome", "ruolo", "squadra", "voto", "fantavoto", "gol", "assist",
               "ammonizione", "espulsione", "squadra_fanta"]


MAX_ROUND_LIMIT = 20  # fixed value


def _round_limit(limit: int) -> int:
    if not 1 <= int(limit) <= MAX_ROUND_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_ROUND_LIMIT}")
    return int(limit)


def round_top(voti: DataFrame, giocatori: DataFrame, asta_log: DataFrame, numero: int,
              limit: int = 10) -> DataFrame:
    """Best grades of round ``numero``: fantavoto desc, NULLs last."""
    order = [F.col("fantavoto").desc_nulls_last()]
    return _round_rows(voti, giocatori, asta_log, numero, order, _round_limit(limit)).select(*_ROUND_COLS)


def round_flop(voti: DataFrame, giocatori: DataFrame, asta_log: DataFrame, numero: int,
               limit: int = 10) -> DataFrame:
    """Worst grades of round ``numero``: NULL counts as 0, ties keep the top order."""
    order = [F.coalesce(F.col("fantavoto"), F.lit(0.0)).asc(), F.col("fantavoto").desc_nulls_last()]
    return _round_rows(voti, giocatori, asta_log, numero, order, _round_limit(limit)).select(*_ROUND_COLS)


def _spent_by_team(asta_log: DataFrame) -> DataFrame:
    # Pre-aggregated before the join: one row per buying team.
    return (asta_log.groupBy(F.col("squadra_acquirente").alias("_team"))
            .agg(F.sum("prezzo_finale").alias("_speso")))


def team_budgets(squadre: DataFrame, asta_log: DataFrame) -> DataFrame:
    """Budget, spent and residual per team, order nome (X10) + low flag."""
    spent = _spent_by_team(asta_log)
    j = squadre.join(spent, squadre.nome == spent._team, "left")
    speso = F.coalesce(F.col("_speso"), F.lit(0.0))
    return j.select(
        "nome", "allenatore", "budget_totale",
        speso.alias("budget_speso"),
        (F.col("budget_totale") - speso).alias("budget_residuo"),
    ).orderBy("nome")


def low_budget(budgets: DataFrame) -> DataFrame:
    """Residual below 15 % of the total."""
    return budgets.withColumn(
        "budget_basso", F.col("budget_residuo") < F.col("budget_totale") * 0.15)


def my_budget(squadre: DataFrame, asta_log: DataFrame, team: str) -> DataFrame:
    """Budget of one team matched case-insensitively (X16). Empty = not found."""
    key = team.lower()
    s = squadre.where(F.lower("nome") == key)
    # implied by the join condition; stated so the scan of asta_log is cut early
    a = asta_log.where(F.lower("squadra_acquirente") == key)
    spent = _spent_by_team(a)
    j = s.join(spent, s.nome == spent._team, "left")
    speso = F.coalesce(F.col("_speso"), F.lit(0.0))
    return j.select(
        "nome", "budget_totale", speso.alias("budget_speso"),
        (F.col("budget_totale") - speso).alias("budget_residuo"))


def my_roster(mia_rosa: DataFrame, giocatori: DataFrame) -> DataFrame:
    """My players, order ruolo, nome."""
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    return (mia_rosa.join(g, mia_rosa.giocatore_id == g.gid)
            .select("nome", "ruolo", "squadra", "prezzo_pagato")
            .orderBy("ruolo", "nome", "prezzo_pagato"))
