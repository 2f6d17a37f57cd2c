"""Player sheet, comparison and my roster performance.

The source app answers these for one player (or a handful) at a time with one
round trip per part. Here every function works on all players at once and takes
an optional id list; per-player work is always grouped on the player key,
whose group size is bounded by seasons x rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up

# Radar labels and the summed columns, in display order.
RADAR = (
    ("Gol", "gol"),
    ("Assist", "assist"),
    ("Rigori parati", "rigori_parati"),
    ("Rigori calciati", "rigori_calciati"),
    ("Ammonizioni", "ammonizioni"),
    ("Espulsioni", "espulsioni"),
    ("Autogol", "autogol"),
)
SEASON_COLUMNS = ("stagione", "presenze", "media_voto", "fantamedia", "gol", "assist",
                  "ammonizioni", "espulsioni", "gol_subiti", "rigori_parati",
                  "rigori_calciati", "bonus", "malus", "autogol")
GRADE_COLUMNS = ("giornata", "voto", "fantavoto", "gol", "assist", "ammonizione",
                 "espulsione", "stagione")
MAX_COMPARED = 4
LAST_GRADES = 38


def _only(df: DataFrame, col: str, ids) -> DataFrame:
    return df if ids is None else df.where(F.col(col).isin(list(ids)))


def player_header(giocatori: DataFrame, mia_rosa: DataFrame, ids=None) -> DataFrame:
    """Player data + price paid + in_rosa flag."""
    g = _only(giocatori, "id", ids)
    mr = mia_rosa.select(F.col("giocatore_id").alias("_mr_id"), "prezzo_pagato")
    j = g.join(mr, g.id == mr._mr_id, "left")
    return j.select("id", "nome", "ruolo", "squadra", "quotazione_attuale", "quotazione_iniziale",
                    "fvm", "prezzo_pagato", F.col("_mr_id").isNotNull().alias("in_rosa"))


def player_seasons(stats: DataFrame, ids=None) -> DataFrame:
    """Seasons of each player (X2b), ascending where players are named; of all players
    in no order, as sorting them would shuffle the whole table."""
    s = _only(stats, "giocatore_id", ids).select("giocatore_id", *SEASON_COLUMNS)
    return s if ids is None else s.orderBy("giocatore_id", "stagione")


def last_grades(voti: DataFrame, ids=None, n: int = LAST_GRADES) -> DataFrame:
    """Per player the first ``n`` grades by season desc, round asc.

    ``row_number <= n`` becomes a WindowGroupLimit: at most n rows per player
    leave each map task.
    """
    v = _only(voti, "giocatore_id", ids)
    w = Window.partitionBy("giocatore_id").orderBy(F.col("stagione").desc(), F.col("giornata").asc())
    return (v.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .select("giocatore_id", *GRADE_COLUMNS))


def fantamedia_trend(stats: DataFrame, ids=None) -> DataFrame:
    """Per player the (season, fantamedia) series in season order (X2d)."""
    s = _only(stats, "giocatore_id", ids)
    return s.groupBy("giocatore_id").agg(
        F.array_sort(F.collect_list(F.struct("stagione", "fantamedia"))).alias("trend"))


def radar_totals(giocatori: DataFrame, stats: DataFrame, ids=None) -> DataFrame:
    """Seven career sums per player as long rows (label, value), NULL -> 0 (X2e)."""
    g = _only(giocatori, "id", ids).select(F.col("id").alias("giocatore_id"))
    sums = _only(stats, "giocatore_id", ids).groupBy("giocatore_id").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for _, c in RADAR])
    j = g.join(sums, "giocatore_id", "left")
    stack = "stack({n}, {pairs}) as (label, value)".format(
        n=len(RADAR),
        pairs=", ".join(f"'{label}', cast(coalesce({c}, 0) as bigint)" for label, c in RADAR))
    return j.select("giocatore_id", F.expr(stack))


def compare_players(giocatori: DataFrame, stats: DataFrame, ids=None) -> DataFrame:
    """Per player six rounded season averages and the season count.

    ``ids``: the first four of the list (duplicates count), best first; None = all
    players, in no order.
    Stats are aggregated per player before the join (join key = group key).
    """
    if ids is not None:
        if isinstance(ids, str):          # "1, 2,3" as in the source app's query string
            ids = ids.split(",")
        ids = [int(str(i).strip()) for i in ids][:MAX_COMPARED]  # a bad integer raises
    g = _only(giocatori, "id", ids)
    s = _only(stats, "giocatore_id", ids).groupBy(F.col("giocatore_id").alias("_sid")).agg(
        F.avg("fantamedia").alias("_fm"), F.avg("media_voto").alias("_mv"),
        F.avg("presenze").alias("_pr"), F.avg("gol").alias("_gol"),
        F.avg("assist").alias("_as"), F.avg("ammonizioni").alias("_amm"),
        F.count("stagione").alias("_n"))
    j = g.join(s, g.id == s._sid, "left")
    out = j.select(
        "id", "nome", "ruolo", "squadra", "quotazione_attuale", "fvm",
        round_half_up(F.col("_fm"), 2).alias("fantamedia_media"),
        round_half_up(F.col("_mv"), 2).alias("media_voto_media"),
        round_half_up(F.col("_pr"), 1).alias("presenze_media"),
        round_half_up(F.col("_gol"), 1).alias("gol_media"),
        round_half_up(F.col("_as"), 1).alias("assist_media"),
        round_half_up(F.col("_amm"), 1).alias("ammonizioni_media"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("stagioni_disponibili"))
    return out if ids is None else out.orderBy(F.col("fantamedia_media").desc_nulls_last(), "id")


# The three comparison charts (chart, metric label, column).
COMPARE_CHARTS = (
    ("voti", "Fantamedia", "fantamedia_media"),
    ("voti", "Media voto", "media_voto_media"),
    ("presenze", "Presenze", "presenze_media"),
    ("bonus", "Gol", "gol_media"),
    ("bonus", "Assist", "assist_media"),
    ("bonus", "Ammonizioni", "ammonizioni_media"),
)


def compare_series(compared: DataFrame) -> DataFrame:
    """Chart rows (chart, series, label, value) of a comparison, NULL -> 0."""
    stack = "stack({n}, {rows}) as (chart, label, value)".format(
        n=len(COMPARE_CHARTS),
        rows=", ".join(f"'{chart}', '{label}', coalesce({c}, cast(0 as double))"
                       for chart, label, c in COMPARE_CHARTS))
    return compared.select(
        "id", F.format_string("%s (%s)", "nome", "squadra").alias("series"), F.expr(stack))


def roster_performance(mia_rosa: DataFrame, giocatori: DataFrame, stats: DataFrame) -> DataFrame:
    """My players with their historical fantamedia."""
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    s = stats.groupBy(F.col("giocatore_id").alias("_sid")).agg(
        F.sum("fantamedia").alias("_sum"), F.count("fantamedia").alias("_cnt"))
    mr = mia_rosa.select("giocatore_id", "prezzo_pagato")
    j = (mr.join(g, mr.giocatore_id == g.gid)
         .join(s, F.col("gid") == s._sid, "left"))
    # one row per (player, price): a player bought twice at different prices
    # appears twice, at the same price once — as GROUP BY id, prezzo_pagato
    per = j.groupBy("gid", "nome", "ruolo", "squadra", "prezzo_pagato").agg(
        F.sum("_sum").alias("_s"), F.sum("_cnt").alias("_c"))
    return per.select(
        F.col("gid").alias("id"), "nome", "ruolo", "squadra", "prezzo_pagato",
        round_half_up(F.col("_s") / F.col("_c"), 2).alias("fantamedia_storica"),
    ).orderBy("ruolo", F.col("fantamedia_storica").desc_nulls_last(), "id")


def roster_grades(mia_rosa: DataFrame, voti: DataFrame) -> DataFrame:
    """Grades of my players, round ascending; a fantavoto of 0 becomes NULL."""
    ids = mia_rosa.select(F.col("giocatore_id").alias("_rid"))
    v = voti.join(ids, voti.giocatore_id == ids._rid, "left_semi")
    return (v.select("giocatore_id", "giornata", "stagione",
                     F.when(F.col("fantavoto") != 0, F.col("fantavoto")).alias("fantavoto"))
            .orderBy("giornata", F.col("stagione").desc(), "giocatore_id"))


def roster_trend(mia_rosa: DataFrame, giocatori: DataFrame, voti: DataFrame) -> DataFrame:
    """Round x player matrix of my roster (X6c), one row per player, one column
    ``g1``..``g38`` per round (the CHECK domain of giornata). Where a round exists
    in several seasons the newest season wins (the source app picks arbitrarily)."""
    grades = roster_grades(mia_rosa, voti)
    per = grades.groupBy("giocatore_id", "giornata").agg(
        F.max_by("fantavoto", "stagione").alias("fv"))
    wide = (per.groupBy("giocatore_id").pivot("giornata", list(range(1, 39)))
            .agg(F.first("fv")))
    wide = wide.select("giocatore_id", *[F.col(str(i)).alias(f"g{i}") for i in range(1, 39)])
    g = giocatori.select(F.col("id").alias("gid"), "nome")
    mr = mia_rosa.select(F.col("giocatore_id").alias("rid")).distinct()
    return (mr.join(g, mr.rid == g.gid).join(wide, F.col("rid") == wide.giocatore_id, "left")
            .select(F.col("rid").alias("giocatore_id"), "nome", *[f"g{i}" for i in range(1, 39)]))
