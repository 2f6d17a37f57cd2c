"""Market by role and the auction strategy snapshot.

The role has four values, so any per-role result is tiny; what matters at scale
is the path to it. Purchases are first collapsed per player (count, price sum),
which also defuses a player bought a huge number of times, then joined to the
player and to the per-player history, then aggregated per role with partial
aggregation. Per-role results are joined back only as broadcasts of a bounded
(<= 5 row) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up
from rosterlake.operators.common import ROLES, free_players
from rosterlake.plans.broadcast import ROLE_ROWS, broadcast_bounded

# Role labels, verdict thresholds and wording.
ROLE_LABELS = {"P": "Portieri", "D": "Difensori", "C": "Centrocampisti", "A": "Attaccanti"}
OVER, UNDER = 1.15, 0.85
VERDICT_NO_DATA = "Dati insufficienti"
VERDICT_OVER = "Il mercato sta pagando %d%% sopra il valore atteso — ruolo gonfiato"
VERDICT_UNDER = "Il mercato sta pagando %d%% sotto il valore atteso — buone occasioni"
VERDICT_FAIR = "Prezzi in linea con il valore atteso"
STRATEGY_NO_DATA = "dati insufficienti"
STRATEGY_OVER = "gonfiato (si paga sopra FVM)"
STRATEGY_UNDER = "conveniente (si paga sotto FVM)"
STRATEGY_FAIR = "in linea con FVM"
ROSTER_TARGET = {"P": 3, "D": 8, "C": 8, "A": 6}
CANDIDATES_PER_ROLE = 5
BUDGET_SCALE = 1000


def _purchases_per_player(asta_log: DataFrame) -> DataFrame:
    return (asta_log.where(F.col("giocatore_id").isNotNull())
            .groupBy(F.col("giocatore_id").alias("_pid"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("prezzo_finale").alias("_price_sum"),
                 F.count("prezzo_finale").alias("_price_n")))


def _role_sums(asta_log: DataFrame, giocatori: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Per role: purchase count and the sums behind the averages (weighted by n)."""
    per = _purchases_per_player(asta_log)
    g = giocatori.select(F.col("id").alias("_gid"), "ruolo", "fvm")
    j = per.join(g, per._pid == g._gid)
    n = F.col("_n")
    aggs = [F.sum(n).alias("acquisti"),
            F.sum("_price_sum").alias("_ps"), F.sum("_price_n").alias("_pn"),
            F.sum(F.col("fvm") * n).alias("_fs"), F.sum(F.when(F.col("fvm").isNotNull(), n)).alias("_fn")]
    if stats is not None:
        hist = stats.groupBy(F.col("giocatore_id").alias("_hid")).agg(
            F.avg("fantamedia").alias("_fm_player"))
        j = j.join(hist, j._gid == hist._hid, "left")
        aggs += [F.sum(F.col("_fm_player") * n).alias("_hs"),
                 F.sum(F.when(F.col("_fm_player").isNotNull(), n)).alias("_hn")]
    return j.groupBy("ruolo").agg(*aggs)


def market_by_role(asta_log: DataFrame, giocatori: DataFrame, stats: DataFrame) -> DataFrame:
    """Per role: purchases, mean price, mean fvm, mean historic fantamedia, ratio."""
    r = _role_sums(asta_log, giocatori, stats)
    avg_p = F.col("_ps") / F.col("_pn")
    avg_f = F.col("_fs") / F.col("_fn")
    return r.select(
        "ruolo", "acquisti",
        round_half_up(avg_p, 1).alias("prezzo_medio_pagato"),
        round_half_up(avg_f, 1).alias("fvm_medio"),
        round_half_up(F.col("_hs") / F.col("_hn"), 2).alias("fantamedia_storica_media"),
        round_half_up(F.try_divide(avg_p, F.when(avg_f != 0, avg_f)), 2).alias("rapporto_prezzo_fvm"),
    ).orderBy("ruolo")


def _label(col: str) -> F.Column:
    m = F.create_map(*[x for k, v in ROLE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.col(col))


def market_verdict(market: DataFrame) -> DataFrame:
    """Verdict per role from the ratio of the *rounded* averages."""
    prezzo = F.coalesce(F.col("prezzo_medio_pagato"), F.lit(0.0))
    fvm = F.coalesce(F.col("fvm_medio"), F.lit(0.0))
    ratio = F.when(fvm > 0, round_half_up(prezzo / F.when(fvm > 0, fvm), 2))
    m = market.withColumn("fvm_medio_norm", fvm).withColumn("rapporto_prezzo_fvm_norm", ratio)
    r = F.col("rapporto_prezzo_fvm_norm")
    pct_over = round_half_up((r - 1) * 100, 0).cast("int")
    pct_under = round_half_up((1 - r) * 100, 0).cast("int")
    valutazione = (F.when(r.isNull(), F.lit(VERDICT_NO_DATA))
                   .when(r > OVER, F.format_string(VERDICT_OVER, pct_over))
                   .when(r < UNDER, F.format_string(VERDICT_UNDER, pct_under))
                   .otherwise(F.lit(VERDICT_FAIR)))
    colore = (F.when(r.isNull(), "gray").when(r > OVER, "red")
              .when(r < UNDER, "green").otherwise("amber"))
    return m.select("*", valutazione.alias("valutazione"), colore.alias("colore"),
                    _label("ruolo").alias("etichetta_ruolo"))


def market_series(verdict: DataFrame) -> DataFrame:
    """Chart rows: price vs fvm per role, and the ratio with threshold 1.0."""
    stack = ("stack(3, 'prezzi', 'Prezzo medio pagato', coalesce(prezzo_medio_pagato, cast(0 as double)), "
             f"'prezzi', 'FVM medio (scala {BUDGET_SCALE})', fvm_medio_norm, "
             "'rapporto', 'Rapporto prezzo / FVM (1.0 = in linea)', rapporto_prezzo_fvm_norm) "
             "as (chart, series, value)")
    return verdict.select("ruolo", F.col("etichetta_ruolo").alias("label"), F.expr(stack),
                          F.lit(1.0).alias("soglia"))


# ------------------------------------------------------------------ X19 strategy
def role_targets(spark) -> DataFrame:
    """The roster target per role as a 4-row DataFrame (fixed values)."""
    return spark.createDataFrame([(r, ROSTER_TARGET[r]) for r in ROLES], "ruolo string, richiesti int")


def strategy_slots(mia_rosa: DataFrame, giocatori: DataFrame) -> DataFrame:
    """Per role: target, taken (by the player's role), missing = max(target - taken, 0)."""
    g = giocatori.select(F.col("id").alias("_gid"), "ruolo")
    taken = (mia_rosa.join(g, mia_rosa.giocatore_id == g._gid)
             .groupBy("ruolo").agg(F.count(F.lit(1)).cast("int").alias("presi")))
    t = role_targets(giocatori.sparkSession)
    j = t.join(broadcast_bounded(taken, ROLE_ROWS, "one row per role"), "ruolo", "left")
    presi = F.coalesce(F.col("presi"), F.lit(0))
    return j.select("ruolo", "richiesti", presi.alias("presi"),
                    F.greatest(F.col("richiesti") - presi, F.lit(0)).alias("mancanti"))


def strategy_budget(squadre: DataFrame, asta_log: DataFrame, slots: DataFrame, team: str) -> DataFrame:
    """Residual budget of ``team`` and the mean budget per missing slot.

    Teams are matched by lower(name) and grouped by budget only, as the source
    app does; no row means the team is not in the census.
    """
    key = team.lower()
    s = squadre.where(F.lower("nome") == key).select("nome", "budget_totale")
    a = (asta_log.where(F.lower("squadra_acquirente") == key)
         .groupBy(F.col("squadra_acquirente").alias("_team")).agg(F.sum("prezzo_finale").alias("_speso")))
    j = s.join(a, s.nome == a._team, "left")
    b = j.groupBy("budget_totale").agg(F.coalesce(F.sum("_speso"), F.lit(0.0)).alias("budget_speso"))
    # a scalar subquery (one value, computed once), not a join
    total_missing = slots.agg(F.sum("mancanti")).scalar()
    res = F.col("budget_totale") - F.col("budget_speso")
    return b.select(
        res.alias("budget_residuo"),
        F.when(total_missing > 0, round_half_up(res / total_missing, 1))
        .otherwise(F.lit(0.0)).alias("budget_medio_per_slot_rimanente"))


def strategy_market(asta_log: DataFrame, giocatori: DataFrame) -> DataFrame:
    """Per role mean price, mean fvm, sample size, verdict on the *unrounded* ratio (X19d)."""
    r = _role_sums(asta_log, giocatori, None)
    prezzo = F.coalesce(F.col("_ps") / F.col("_pn"), F.lit(0.0))
    fvm = F.coalesce(F.col("_fs") / F.col("_fn"), F.lit(0.0))
    ratio = F.when(fvm > 0, prezzo / F.when(fvm > 0, fvm))
    valutazione = (F.when(ratio.isNull(), F.lit(STRATEGY_NO_DATA))
                   .when(ratio > OVER, F.lit(STRATEGY_OVER))
                   .when(ratio < UNDER, F.lit(STRATEGY_UNDER))
                   .otherwise(F.lit(STRATEGY_FAIR)))
    return r.select("ruolo",
                    round_half_up(prezzo, 1).alias("prezzo_medio_pagato"),
                    round_half_up(fvm, 1).alias("fvm_medio"),
                    valutazione.alias("valutazione"),
                    F.col("acquisti").alias("campione"))


def strategy_candidates(giocatori: DataFrame, asta_log: DataFrame, slots: DataFrame,
                        k: int = CANDIDATES_PER_ROLE) -> DataFrame:
    """For every role still missing players: the best ``k`` free players by fvm (X19e).

    One anti-join and one ranked window for all roles (instead of a query per
    role). ``row_number <= k`` over the 4 roles runs as a WindowGroupLimit: each
    map task keeps only k rows per role before the shuffle, so the 4 role groups
    never carry more than k x tasks rows.
    """
    missing = slots.where(F.col("mancanti") > 0).select(F.col("ruolo").alias("_r"))
    free = free_players(giocatori, asta_log)
    missing = broadcast_bounded(missing, ROLE_ROWS, "roles still missing")
    free = free.join(missing, free.ruolo == missing._r, "left_semi")
    w = Window.partitionBy("ruolo").orderBy(F.col("fvm").desc_nulls_last(), F.col("id").asc())
    return (free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("ruolo", "rank", "nome", "squadra", "quotazione_attuale", "fvm"))
