"""Player searches (X1, X11, X11b, X11c, X11d, X14, X15, X18, X20).

All searches are composed filters: optional predicates are added only when the
argument is set, sorting goes through a whitelist, and every top-k ends with a
unique tie-break so the chosen rows do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.common import any_of, capped_limit, free_players, like_pattern, ordered

# Sortable columns of the two search tools (name -> column).
PLAYER_SORT_COLUMNS = {
    "fvm": "fvm",
    "quotazione_attuale": "quotazione_attuale",
    "quotazione_iniziale": "quotazione_iniziale",
    "nome": "nome",
}
STAT_SORT_COLUMNS = {
    "fantamedia": "fantamedia",
    "media_voto": "media_voto",
    "gol": "gol",
    "assist": "assist",
    "presenze": "presenze",
    "ammonizioni": "ammonizioni",
    "espulsioni": "espulsioni",
    "rigori_parati": "rigori_parati",
    "autogol": "autogol",
}
HISTORY_SORT_COLUMNS = ("nome", "ruolo", "prezzo_finale", "squadra_acquirente", "creato_il")


def name_search(giocatori: DataFrame, q: str, escape: bool = False) -> DataFrame:
    """Partial, case-insensitive name match; first 20 by nome."""
    if q is None or len(q) < 2:
        raise ValueError("q must have at least 2 characters")
    return (giocatori.where(F.col("nome").ilike(like_pattern(q, escape)))
            .select("id", "nome", "ruolo", "squadra", "quotazione_attuale", "fvm")
            .orderBy("nome", "id").limit(20))


def free_list(giocatori: DataFrame, asta_log: DataFrame, ruolo: str | None = None) -> DataFrame:
    """Players not yet sold, optionally of one role (X11)."""
    g = giocatori.where(F.col("ruolo") == ruolo) if ruolo else giocatori
    return free_players(g, asta_log).select("id", "nome", "ruolo", "squadra", "quotazione_attuale")


def free_search(giocatori: DataFrame, asta_log: DataFrame, nome: str,
                solo_liberi: bool = True) -> DataFrame:
    """Live name search, free players by default; first 10 by fvm desc."""
    g = giocatori.where(F.col("nome").ilike(like_pattern(nome)))
    if solo_liberi:
        g = free_players(g, asta_log)
    return (g.select("id", "nome", "ruolo", "squadra", "quotazione_attuale", "fvm")
            .orderBy(F.col("fvm").desc_nulls_last(), "id").limit(10))


def purchase_history(asta_log: DataFrame, giocatori: DataFrame) -> DataFrame:
    """Every purchase with the player's data (input of X11c / X11d)."""
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    return asta_log.join(g, asta_log.giocatore_id == g.gid).select(
        "id", "nome", "ruolo", "squadra", "prezzo_finale", "squadra_acquirente", "fonte", "creato_il",
        F.date_format("creato_il", "HH:mm").alias("ora"))  # time of day shown in the list


def recent_purchases(asta_log: DataFrame, giocatori: DataFrame, limit: int = 20) -> DataFrame:
    """Newest purchases first (X11c): a top-k, never a global sort."""
    return (purchase_history(asta_log, giocatori)
            .orderBy(F.col("creato_il").desc_nulls_last(), F.col("id").desc()).limit(int(limit)))


def history_filter(history: DataFrame, text: str | None, sort_col: str | None = None,
                   direction: str = "desc") -> DataFrame:
    """Contains-filter on player name or buyer (X11d), sorted by a whitelisted column
    where one is asked for (an unknown name means ``creato_il``)."""
    t = (text or "").strip().lower()
    h = history
    if t:
        h = h.where(F.lower("nome").contains(t) | F.lower("squadra_acquirente").contains(t))
    if sort_col is None:
        return h
    if sort_col not in HISTORY_SORT_COLUMNS:
        sort_col = "creato_il"
    asc = direction == "asc"
    return h.orderBy(ordered(sort_col, asc), F.col("creato_il").desc_nulls_last(), F.col("id").desc())


def structured_search(giocatori: DataFrame, asta_log: DataFrame, ruolo: str | None = None,
                      squadra: str | None = None, escludi_squadra: str | None = None,
                      order_by: str = "fvm", ordine: str = "desc", limit=10,
                      solo_liberi: bool = True) -> DataFrame:
    """Composed optional filters + whitelisted order + capped limit."""
    col = PLAYER_SORT_COLUMNS.get(order_by, "fvm")
    lim = capped_limit(limit)
    g = giocatori
    if ruolo:
        g = g.where(F.col("ruolo") == ruolo)
    if squadra:
        g = g.where(F.col("squadra").ilike(like_pattern(squadra)))
    if escludi_squadra:
        g = g.where(~F.col("squadra").ilike(like_pattern(escludi_squadra)))
    if solo_liberi:
        g = free_players(g, asta_log)
    return (g.orderBy(ordered(col, ordine == "asc"), F.col("id"))
            .limit(lim).select("nome", "ruolo", "squadra", "quotazione_attuale", "fvm"))


def season_search(stats: DataFrame, giocatori: DataFrame, stagione: str | None = None,
                  ruolo: str | None = None, nome: str | None = None,
                  order_by: str = "fantamedia", ordine: str = "desc", limit=10) -> DataFrame:
    """Season statistics joined to players, optional filters, top-k."""
    col = STAT_SORT_COLUMNS.get(order_by, "fantamedia")
    lim = capped_limit(limit)
    s = stats.where(F.col("stagione") == stagione) if stagione else stats
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    if ruolo:
        g = g.where(F.col("ruolo") == ruolo)
    if nome:
        g = g.where(F.col("nome").ilike(like_pattern(nome)))
    j = s.join(g, s.giocatore_id == g.gid)
    return (j.orderBy(ordered(col, ordine == "asc"), F.col("id"))
            .limit(lim)
            .select("nome", "ruolo", "squadra", "stagione", "presenze", "media_voto", "fantamedia",
                    "gol", "assist", "ammonizioni", "espulsioni", "gol_subiti", "rigori_parati",
                    "autogol"))


def team_roster(asta_log: DataFrame, giocatori: DataFrame, squadre: DataFrame,
                nome_squadra: str) -> DataFrame:
    """Players bought by the teams whose name or coach matches any word.

    The word match is a filter on the teams (the small side, pushed into its
    scan), never a join condition: both joins stay equi-joins.
    """
    words = [w for w in (nome_squadra or "").strip().split() if w]
    s = squadre.select(F.col("nome").alias("nome_squadra"), "allenatore")
    if not words:
        return giocatori.sparkSession.createDataFrame(
            [], "nome string, ruolo string, squadra string, prezzo_finale double, "
                "nome_squadra string, allenatore string")
    s = s.where(any_of([F.col("nome_squadra").ilike(like_pattern(w)) | F.col("allenatore").ilike(like_pattern(w))
                        for w in words]))
    g = giocatori.select(F.col("id").alias("gid"), "nome", "ruolo", "squadra")
    j = (asta_log.select("id", "giocatore_id", "prezzo_finale", "squadra_acquirente")
         .join(g, F.col("giocatore_id") == g.gid)
         .join(s, F.col("squadra_acquirente") == s.nome_squadra))
    return (j.orderBy("ruolo", "nome", "id")
            .select("nome", "ruolo", "squadra", "prezzo_finale", "nome_squadra", "allenatore"))


def current_season(stats: DataFrame) -> DataFrame:
    """Greatest season label (X20): an aggregate, not a sort."""
    return stats.agg(F.max("stagione").alias("stagione"))
