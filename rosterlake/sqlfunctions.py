"""The chat tools as SQL table functions over views of the league tables.

``register(spark, tables)`` makes the temporary views ``giocatori``, ``statistiche_storiche``,
``squadre``, ``asta_log`` and ``mia_rosa`` and the temporary functions below. Every argument
has a name and a default, as the tools' arguments have::

    SELECT * FROM cerca_giocatori(ruolo => 'A', limite => 5)

They are declarative SQL over the views: Catalyst inlines them, pushes their filters
into the scans and plans their ranks as top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.functions.numeric import round_sql as R
from rosterlake.operators import market, search
from rosterlake.operators.common import ROLES

VIEWS = ("giocatori", "statistiche_storiche", "squadre", "asta_log", "mia_rosa")
_LIMIT = "least(coalesce(nullif(limite, 0), 10), 50)"
_SOLD = "SELECT giocatore_id FROM asta_log WHERE giocatore_id IS NOT NULL"
_WORDS = "filter(split(trim(coalesce(parole, '')), '\\\\s+'), w -> w <> '')"


def _order(columns: dict[str, str], default: str, table: str) -> str:
    """ORDER BY a column named by ``ordina``, up if ``ordine`` is asc, NULLs last, then id."""
    name = f"CASE WHEN ordina IN ({', '.join(repr(c) for c in columns)}) THEN ordina ELSE '{default}' END"
    numbers = " ".join(f"WHEN '{k}' THEN CAST({table}.{c} AS DOUBLE)" for k, c in columns.items() if c != "nome")
    keys = [f"CASE WHEN ordine = 'asc' THEN 1 ELSE -1 END * (CASE {name} {numbers} END) ASC NULLS LAST"]
    if "nome" in columns:
        keys = [f"CASE WHEN ordine = 'asc' AND {name} = 'nome' THEN {table}.nome END ASC NULLS LAST",
                f"CASE WHEN ordine <> 'asc' AND {name} = 'nome' THEN {table}.nome END DESC NULLS LAST", *keys]
    return ", ".join([*keys, f"{table}.id"])


def _functions(team: str) -> dict[str, str]:
    target = ", ".join(f"('{r}', {market.ROSTER_TARGET[r]})" for r in ROLES)
    season = ("s.stagione, s.presenze, s.media_voto, s.fantamedia, s.gol, s.assist, s.ammonizioni, s.espulsioni, "
              "s.gol_subiti, s.rigori_parati, s.autogol")
    ratio = "avg(a.prezzo_finale) / nullif(avg(g.fvm), 0)"
    return {
        "cerca_giocatori": f"""(ruolo_cercato STRING DEFAULT NULL, squadra_cercata STRING DEFAULT NULL, escludi_squadra STRING DEFAULT NULL,
            ordina STRING DEFAULT 'fvm', ordine STRING DEFAULT 'desc', limite INT DEFAULT 10, solo_liberi BOOLEAN DEFAULT true)
            RETURNS TABLE (nome STRING, ruolo STRING, squadra STRING, quotazione_attuale DOUBLE, fvm DOUBLE)
            RETURN SELECT nome, ruolo, squadra, quotazione_attuale, fvm FROM (
                SELECT g.*, row_number() OVER (ORDER BY {_order(search.PLAYER_SORT_COLUMNS, 'fvm', 'g')}) AS posto FROM giocatori g
                LEFT JOIN (SELECT DISTINCT giocatore_id FROM ({_SOLD})) v ON v.giocatore_id = g.id
                WHERE (ruolo_cercato IS NULL OR g.ruolo = ruolo_cercato)
                  AND (squadra_cercata IS NULL OR g.squadra ILIKE concat('%', squadra_cercata, '%'))
                  AND (escludi_squadra IS NULL OR g.squadra NOT ILIKE concat('%', escludi_squadra, '%'))
                  AND (NOT solo_liberi OR v.giocatore_id IS NULL)) WHERE posto <= {_LIMIT}""",
        "cerca_statistiche": f"""(stagione_cercata STRING DEFAULT NULL, ruolo_cercato STRING DEFAULT NULL, nome_cercato STRING DEFAULT NULL,
            ordina STRING DEFAULT 'fantamedia', ordine STRING DEFAULT 'desc', limite INT DEFAULT 10)
            RETURNS TABLE (nome STRING, ruolo STRING, squadra STRING, stagione STRING, presenze INT, media_voto DOUBLE, fantamedia DOUBLE,
                gol INT, assist INT, ammonizioni INT, espulsioni INT, gol_subiti INT, rigori_parati INT, autogol INT)
            RETURN SELECT nome, ruolo, squadra, {season.replace('s.', '')} FROM (
                SELECT g.nome, g.ruolo, g.squadra, {season}, row_number() OVER (ORDER BY {_order(search.STAT_SORT_COLUMNS, 'fantamedia', 's')}) AS posto
                FROM statistiche_storiche s JOIN giocatori g ON g.id = s.giocatore_id
                WHERE (stagione_cercata IS NULL OR s.stagione = stagione_cercata) AND (ruolo_cercato IS NULL OR g.ruolo = ruolo_cercato)
                  AND (nome_cercato IS NULL OR g.nome ILIKE concat('%', nome_cercato, '%'))) WHERE posto <= {_LIMIT}""",
        "mio_budget": f"""(squadra_mia STRING DEFAULT '{team}')
            RETURNS TABLE (nome STRING, budget_totale DOUBLE, budget_speso DOUBLE, budget_residuo DOUBLE)
            RETURN SELECT s.nome, s.budget_totale, coalesce(a.speso, 0), s.budget_totale - coalesce(a.speso, 0)
                FROM squadre s LEFT JOIN (SELECT squadra_acquirente, sum(prezzo_finale) AS speso FROM asta_log
                    WHERE lower(squadra_acquirente) = lower(squadra_mia) GROUP BY squadra_acquirente) a ON a.squadra_acquirente = s.nome
                WHERE lower(s.nome) = lower(squadra_mia)""",
        "la_mia_rosa": """(ruolo_cercato STRING DEFAULT NULL)
            RETURNS TABLE (nome STRING, ruolo STRING, squadra STRING, prezzo_pagato DOUBLE)
            RETURN SELECT g.nome, g.ruolo, g.squadra, m.prezzo_pagato FROM mia_rosa m JOIN giocatori g ON g.id = m.giocatore_id
                WHERE ruolo_cercato IS NULL OR g.ruolo = ruolo_cercato""",
        "rosa_di_squadra": f"""(parole STRING DEFAULT '')
            RETURNS TABLE (nome STRING, ruolo STRING, squadra STRING, prezzo_finale DOUBLE, nome_squadra STRING, allenatore STRING)
            RETURN SELECT g.nome, g.ruolo, g.squadra, a.prezzo_finale, s.nome, s.allenatore
                FROM asta_log a JOIN giocatori g ON g.id = a.giocatore_id JOIN squadre s ON s.nome = a.squadra_acquirente
                WHERE exists({_WORDS}, w -> coalesce(s.nome ILIKE concat('%', w, '%'), false) OR coalesce(s.allenatore ILIKE concat('%', w, '%'), false))""",
        "strategia_posti": f"""(ruolo_cercato STRING DEFAULT NULL) RETURNS TABLE (ruolo STRING, richiesti INT, presi INT, mancanti INT)
            RETURN SELECT t.ruolo, t.richiesti, CAST(coalesce(p.presi, 0) AS INT), CAST(greatest(t.richiesti - coalesce(p.presi, 0), 0) AS INT)
                FROM (VALUES {target}) t(ruolo, richiesti)
                LEFT JOIN (SELECT g.ruolo, count(*) AS presi FROM mia_rosa m JOIN giocatori g ON g.id = m.giocatore_id GROUP BY g.ruolo) p
                ON p.ruolo = t.ruolo WHERE ruolo_cercato IS NULL OR t.ruolo = ruolo_cercato""",
        "strategia_mercato": f"""(ruolo_cercato STRING DEFAULT NULL)
            RETURNS TABLE (ruolo STRING, prezzo_medio_pagato DOUBLE, fvm_medio DOUBLE, valutazione STRING, campione BIGINT)
            RETURN SELECT g.ruolo, {R('coalesce(avg(a.prezzo_finale), 0)', 1)}, {R('coalesce(avg(g.fvm), 0)', 1)},
                CASE WHEN coalesce(avg(g.fvm), 0) <= 0 THEN '{market.STRATEGY_NO_DATA}' WHEN {ratio} > {market.OVER}D THEN '{market.STRATEGY_OVER}'
                     WHEN {ratio} < {market.UNDER}D THEN '{market.STRATEGY_UNDER}' ELSE '{market.STRATEGY_FAIR}' END, count(*)
                FROM asta_log a JOIN giocatori g ON g.id = a.giocatore_id
                WHERE ruolo_cercato IS NULL OR g.ruolo = ruolo_cercato GROUP BY g.ruolo""",
        "strategia_candidati": f"""(per_ruolo INT DEFAULT {market.CANDIDATES_PER_ROLE})
            RETURNS TABLE (ruolo STRING, posto INT, nome STRING, squadra STRING, quotazione_attuale DOUBLE, fvm DOUBLE)
            RETURN SELECT ruolo, posto, nome, squadra, quotazione_attuale, fvm FROM (
                SELECT g.*, row_number() OVER (PARTITION BY g.ruolo ORDER BY g.fvm DESC NULLS LAST, g.id) AS posto FROM giocatori g
                JOIN (SELECT ruolo FROM strategia_posti() WHERE mancanti > 0) r ON r.ruolo = g.ruolo
                LEFT ANTI JOIN (SELECT DISTINCT giocatore_id FROM ({_SOLD})) v ON v.giocatore_id = g.id) WHERE posto <= per_ruolo""",
    }


def register(spark: SparkSession, tables: dict[str, DataFrame], team: str) -> None:
    """Make the views and functions in the session; ``team`` is the default of ``mio_budget``."""
    if missing := set(VIEWS) - set(tables):
        raise ValueError(f"missing tables: {sorted(missing)}")
    for name in VIEWS:
        tables[name].createOrReplaceTempView(name)
    for name, text in _functions(team.replace("'", "''")).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {text}")
