"""Expected value score of free players (X4) — the flagship query.

Plan: free players (anti-join on the distinct sold ids) -> left join with the
seasons, so that only candidates' seasons are ranked -> newest 4 per player
(``row_number``, on the join's partitioning) -> one row per player with the 4 ranked
values pivoted into columns (fixed summation order, same partitioning) -> per-role
maxima as a 4-row aggregate broadcast back -> ``orderBy(score desc, id).limit``
(top-k, no global sort). The maxima and the ranking read the same shuffles, which
Spark reuses; nothing is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up
from rosterlake.operators.common import free_players
from rosterlake.plans.broadcast import ROLE_ROWS, broadcast_bounded

# Fixed values of the score (must equal the source app's):
SEASON_WEIGHTS = (3.0, 2.0, 1.0, 0.5)   # newest season first; at most 4 seasons
RELIABILITY_STEPS = ((10, 0.30), (20, 0.60), (28, 0.85))  # weighted appearances < bound
RELIABILITY_TOP = 1.00
FVM_SHARE, FORM_SHARE = 0.60, 0.40
MAX_LIMIT = 50


def newest_seasons(stats: DataFrame, n: int = len(SEASON_WEIGHTS)) -> DataFrame:
    """The ``n`` newest seasons of every player with their rank ``rn`` (1 = newest)."""
    w = Window.partitionBy("giocatore_id").orderBy(F.col("stagione").desc())
    return (stats.select("giocatore_id", "stagione", "fantamedia", "presenze")
            .withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= n))


def _weighted(cols: list) -> F.Column:
    total = None
    for c, w in zip(cols, SEASON_WEIGHTS):
        term = F.coalesce(c, F.lit(0.0)) * F.lit(w)
        total = term if total is None else total + term
    return total


def _ranked_measures(detail: bool) -> list:
    """Aggregates over rows with ``rn``: the 4 newest seasons as columns, and their number."""
    k = range(1, len(SEASON_WEIGHTS) + 1)
    rn = F.col("rn")
    aggs = [F.max(F.when(rn == i, F.coalesce(F.col("fantamedia"), F.lit(0.0)))).alias(f"_fm{i}") for i in k]
    aggs += [F.max(F.when(rn == i, F.coalesce(F.col("presenze"), F.lit(0)).cast("double"))).alias(f"_pr{i}")
             for i in k]
    aggs.append(F.count("giocatore_id").alias("_n"))
    if detail:
        season = F.struct(
            "rn", "stagione",
            F.coalesce(F.col("fantamedia"), F.lit(0.0)).alias("fantamedia"),
            F.coalesce(F.col("presenze"), F.lit(0)).cast("double").alias("presenze"))
        aggs.append(F.array_sort(F.collect_list(F.when(F.col("giocatore_id").isNotNull(), season))).alias("stagioni_dettaglio"))
    return aggs


def player_form(stats: DataFrame, detail: bool = False) -> DataFrame:
    """Per player: the newest 4 seasons' fantamedia and appearances as columns."""
    return newest_seasons(stats).groupBy("giocatore_id").agg(*_ranked_measures(detail))


def expected_value(giocatori: DataFrame, stats: DataFrame, asta_log: DataFrame,
                   ruolo: str | None = None, budget_max: float | None = None,
                   limit: int = 20, detail: bool = False) -> DataFrame:
    """Score 0-100 of every free player; the best ``limit`` (<= 50) by score, id. With
    ``detail`` (A10) each row also lists its seasons, newest first, by rank."""
    if not 1 <= int(limit) <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    limit = int(limit)
    cand = free_players(giocatori, asta_log)
    if ruolo:
        cand = cand.where(F.col("ruolo") == ruolo)
    if budget_max:  # 0 and None mean "no cap", as in the source app
        cand = cand.where(F.col("fvm") <= budget_max)

    player = ["id", "nome", "ruolo", "squadra", "quotazione_attuale", "fvm"]
    seasons = stats.select("giocatore_id", "stagione", "fantamedia", "presenze")
    newest = Window.partitionBy("id").orderBy(F.col("stagione").desc())
    j = (cand.select(*player).join(seasons, F.col("id") == F.col("giocatore_id"), "left")
         .withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= len(SEASON_WEIGHTS))
         .groupBy(*player).agg(*_ranked_measures(detail)))

    n = F.coalesce(F.col("_n"), F.lit(0))
    sw = None
    for i, w in enumerate(SEASON_WEIGHTS, start=1):
        term = F.when(n >= i, F.lit(w)).otherwise(F.lit(0.0))
        sw = term if sw is None else sw + term
    fm_sum = _weighted([F.col(f"_fm{i}") for i in range(1, 5)])
    pr_sum = _weighted([F.col(f"_pr{i}") for i in range(1, 5)])
    fm_pond = F.when(n > 0, fm_sum / sw)
    pr_pond = F.when(n > 0, pr_sum / sw).otherwise(F.lit(0.0))
    aff = None
    for bound, value in RELIABILITY_STEPS:
        aff = F.when(pr_pond < bound, F.lit(value)) if aff is None else aff.when(pr_pond < bound, F.lit(value))
    aff = aff.otherwise(F.lit(RELIABILITY_TOP))

    cols = [
        "id", "nome", "ruolo", "squadra",
        F.coalesce(F.col("quotazione_attuale"), F.lit(0.0)).alias("quotazione_attuale"),
        F.coalesce(F.col("fvm"), F.lit(0.0)).alias("fvm"),
        round_half_up(fm_pond, 2).alias("fantamedia_ponderata"),
        round_half_up(pr_pond, 1).alias("presenze_medie_pond"),
        aff.alias("affidabilita"),
        n.cast("int").alias("n_stagioni"),
    ]
    if detail:
        cols.append("stagioni_dettaglio")
    scored = j.select(*cols)

    # Per-role maxima over the filtered candidates; a max of 0 becomes 1. At most
    # one row per role (the ruolo CHECK bounds it), so the broadcast is bounded.
    maxes = scored.groupBy(F.col("ruolo").alias("_ruolo")).agg(
        F.max("fvm").alias("_mf"),
        F.max(F.coalesce(F.col("fantamedia_ponderata"), F.lit(0.0))).alias("_mm"))
    maxes = maxes.select(
        "_ruolo",
        F.when(F.col("_mf") == 0, F.lit(1.0)).otherwise(F.col("_mf")).alias("_mf"),
        F.when(F.col("_mm") == 0, F.lit(1.0)).otherwise(F.col("_mm")).alias("_mm"))
    maxes = broadcast_bounded(maxes, ROLE_ROWS, "one row per role")
    s = scored.join(maxes, scored.ruolo.eqNullSafe(maxes._ruolo))
    fvm_norm = F.col("fvm") / F.col("_mf")
    fm_norm = F.coalesce(F.col("fantamedia_ponderata"), F.lit(0.0)) / F.col("_mm")
    score = round_half_up((fvm_norm * FVM_SHARE + fm_norm * FORM_SHARE) * F.col("affidabilita") * 100, 1)
    out = s.withColumn("score", score).drop("_ruolo", "_mf", "_mm")
    return out.orderBy(F.col("score").desc_nulls_last(), F.col("id").asc()).limit(limit)
