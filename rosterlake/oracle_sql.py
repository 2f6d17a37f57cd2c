"""The league model as SQL CTEs over the driver tables, for the DuckDB oracle.

Each query's oracle text is ``with_model(body)``: the CTEs the body refers to
(and their dependencies) are put in front of it. The definitions mirror
``rosterlake.sources.model`` one to one.
"""

from __future__ import annotations

import re

from rosterlake.functions.numeric import round_sql
from rosterlake.sources.model import (AUCTION_BUDGET, LOG_APP_NAME, MY_TEAM, MY_USER, NEW_PLAYER, RENUMBERED_SIZE, SHEET_DIR,
                                      TEAMS_PER_SUPPLIER)

R = round_sql

MODEL_CTES: dict[str, str] = {
    "giocatori": """
        SELECT p_partkey AS id, p_partkey AS fanta_id, p_name AS nome,
               CASE WHEN p_size <= 12 THEN 'P' WHEN p_size <= 25 THEN 'D'
                    WHEN p_size <= 38 THEN 'C' ELSE 'A' END AS ruolo,
               p_brand AS squadra,
               CAST(p_size AS DOUBLE) AS quotazione_iniziale,
               CAST(p_size AS DOUBLE) AS quotazione_attuale,
               CAST(p_size + 30 AS DOUBLE) AS fvm
        FROM part""",
    "statistiche": f"""
        SELECT giocatore_id * 10000 + anno AS id, giocatore_id,
               concat(CAST(anno AS VARCHAR), '/', lpad(CAST((anno + 1) % 100 AS VARCHAR), 2, '0')) AS stagione,
               presenze, gol, assist, {R('_mv', 2)} AS media_voto, {R('_fm', 2)} AS fantamedia,
               gol_subiti, rigori_parati, rigori_calciati, bonus, malus, autogol,
               ammonizioni, espulsioni
        FROM (
            SELECT l_partkey AS giocatore_id, year(l_shipdate) AS anno,
                   CAST(sum(l_linenumber) AS INTEGER) AS presenze,
                   CAST(count(*) AS INTEGER) AS gol,
                   CAST(count_if(l_returnflag = 'R') AS INTEGER) AS assist,
                   avg(round(l_discount * 100)) AS _mv,
                   avg(l_quantity) AS _fm,
                   CAST(count_if(l_linestatus = 'O') AS INTEGER) AS gol_subiti,
                   CAST(count_if(l_quantity <= 2) AS INTEGER) AS rigori_parati,
                   CAST(count_if(l_quantity >= 48) AS INTEGER) AS rigori_calciati,
                   CAST(count_if(l_quantity >= 40) AS INTEGER) AS bonus,
                   CAST(count_if(l_quantity <= 10) AS INTEGER) AS malus,
                   CAST(count_if(l_quantity = 1) AS INTEGER) AS autogol,
                   CAST(count_if(l_returnflag = 'A') AS INTEGER) AS ammonizioni,
                   CAST(count_if(l_tax >= 0.075) AS INTEGER) AS espulsioni
            FROM lineitem GROUP BY l_partkey, year(l_shipdate)) x""",
    "squadre": """
        SELECT c_custkey AS id, c_name AS nome, n_name AS allenatore, c_acctbal AS budget_totale
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "asta_log": f"""
        SELECT l_orderkey AS id, l_partkey - l_partkey % 3 AS giocatore_id, l_quantity AS prezzo_finale,
               'Customer#' || lpad(CAST(l_suppkey * {TEAMS_PER_SUPPLIER} + l_orderkey % {TEAMS_PER_SUPPLIER} AS VARCHAR), 9, '0') AS squadra_acquirente,
               'lineitem' AS fonte, l_shipdate AS creato_il
        FROM (SELECT DISTINCT ON (l_orderkey) * FROM lineitem
              ORDER BY l_orderkey, l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_shipdate DESC) w""",
    "mia_rosa": f"""
        SELECT f.id, f.giocatore_id, f.prezzo_finale AS prezzo_pagato, g.ruolo AS ruolo_fanta,
               f.creato_il AS acquistato_il
        FROM (SELECT *, row_number() OVER (PARTITION BY giocatore_id ORDER BY creato_il, id) AS rn
              FROM asta_log WHERE squadra_acquirente = '{MY_TEAM}') f
        LEFT JOIN giocatori g ON g.id = f.giocatore_id
        WHERE f.rn = 1""",
    "voti_giornata": """
        SELECT giocatore_id * 1000000 + anno * 100 + giornata AS id, giocatore_id, giornata,
               concat(CAST(anno AS VARCHAR), '/', lpad(CAST((anno + 1) % 100 AS VARCHAR), 2, '0')) AS stagione,
               voto, fantavoto, gol, assist, ammonizione, espulsione
        FROM (SELECT l_partkey AS giocatore_id, year(l_shipdate) AS anno,
                     CAST(day(l_shipdate) AS INTEGER) AS giornata,
                     min(l_quantity) / 5 AS voto, (max(l_quantity) - 1) / 5 AS fantavoto,
                     CAST(count_if(l_returnflag = 'R') AS INTEGER) AS gol,
                     CAST(count_if(l_returnflag = 'A') AS INTEGER) AS assist,
                     bool_or(l_linestatus = 'O') AS ammonizione,
                     bool_or(l_tax >= 0.075) AS espulsione
              FROM lineitem GROUP BY l_partkey, year(l_shipdate), CAST(day(l_shipdate) AS INTEGER)) v""",
    "purchase_attempts": f"""
        SELECT ts, event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS giocatore_id,
               value AS prezzo_finale, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS squadra_acquirente,
               user_id = {MY_USER} AS e_mio, 'events' AS fonte
        FROM events WHERE event_type = 'purchase'""",
    "auction_census": f"""
        SELECT DISTINCT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS nome,
               CAST(NULL AS VARCHAR) AS allenatore, CAST({AUCTION_BUDGET} AS DOUBLE) AS budget_totale
        FROM events WHERE event_type = 'signup'""",
    "calendario": f"""
        SELECT min(o_orderkey) AS id, giornata, squadra_casa,
               'Customer#' || lpad(CAST(min(o_orderkey) % 1000 AS VARCHAR), 9, '0') AS squadra_trasferta, min(o_orderdate) AS data_partita, stagione
        FROM (SELECT *, CAST(day(o_orderdate) AS INTEGER) AS giornata, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS squadra_casa,
                     concat(CAST(year(o_orderdate) AS VARCHAR), '/', lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')) AS stagione FROM orders) o
        GROUP BY giornata, squadra_casa, stagione""",
    "formazioni_probabili": """
        SELECT min(p_partkey) AS id, CAST(p_size % 38 + 1 AS INTEGER) AS giornata, p_brand AS squadra, '4-3-3' AS modulo,
               list(p_name ORDER BY p_partkey) AS titolari, 'part' AS fonte, CAST(NULL AS TIMESTAMP) AS creato_il
        FROM part GROUP BY ALL""",
    "request_logs": """
        SELECT event_id AS id, ts, CAST(to_json({'method': CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END,
               'path': '/' || event_type, 'status': CASE WHEN event_type = 'error' THEN 503 ELSE 200 END, 'ms': value}) AS VARCHAR) AS extra
        FROM events""",
    "app_logs": f"""
        SELECT event_id AS id, ts, upper(event_type) AS level,
               concat_ws(' ', event_type, CAST(event_id AS VARCHAR)) AS message,
               props AS extra, '{LOG_APP_NAME}' AS app_name
        FROM events""",
    "previous_players": "SELECT * FROM giocatori",
    "price_sheet": f"""
        SELECT CAST(p_partkey + CASE WHEN p_size > {RENUMBERED_SIZE} THEN {NEW_PLAYER} ELSE 0 END AS VARCHAR) AS "Id",
               CASE WHEN p_size <= 12 THEN 'P' WHEN p_size <= 25 THEN 'D'
                    WHEN p_size <= 38 THEN 'C' ELSE 'A' END AS "R",
               '  ' || p_name || ' ' AS "Nome", p_brand AS "Squadra",
               CAST(p_size + 1 AS VARCHAR) AS "Qt.A", CAST(p_size AS VARCHAR) AS "Qt.I",
               CAST(p_size * 3 AS VARCHAR) AS "FVM", p_partkey AS _ordinal
        FROM part""",
    "stats_sheets": f"""
        SELECT CASE WHEN CAST(substr(stagione, 1, 4) AS INTEGER) % 2 = 0
                    THEN 'Statistiche Fantacalcio Stagione ' || substr(stagione, 1, 4) || ' ' || substr(stagione, 6, 2)
                    ELSE 'Statistiche Fantacalcio' END AS _title,
               '{SHEET_DIR}/Statistiche_' || substr(stagione, 1, 4) || '_' || substr(stagione, 6, 2) || '.csv' AS _path,
               CAST(giocatore_id + CASE WHEN presenze % 10 = 9 THEN {NEW_PLAYER} ELSE 0 END AS VARCHAR) AS "Id",
               CASE WHEN presenze % 10 <> 8 THEN CAST(presenze AS VARCHAR) END AS "Pv",
               CAST(media_voto AS VARCHAR) AS "Mv", CAST(fantamedia AS VARCHAR) AS "Fm",
               CAST(gol AS VARCHAR) AS "Gf", CAST(gol_subiti AS VARCHAR) AS "Gs",
               CAST(rigori_parati AS VARCHAR) AS "Rp", CAST(rigori_calciati AS VARCHAR) AS "Rc",
               CAST(bonus AS VARCHAR) AS "R+", CAST(malus AS VARCHAR) AS "R-",
               CAST(assist AS VARCHAR) AS "Ass", CAST(ammonizioni AS VARCHAR) AS "Amm",
               CAST(espulsioni AS VARCHAR) AS "Esp", CAST(autogol AS VARCHAR) AS "Au"
        FROM statistiche""",
}

_DEPS = {"mia_rosa": ["asta_log", "giocatori"], "previous_players": ["giocatori"],
         "stats_sheets": ["statistiche"]}


def with_model(body: str) -> str:
    """Prefix ``body`` with the model CTEs it uses (in dependency order)."""
    used: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPS.get(name, []):
            add(dep)
        if name not in used:
            used.append(name)

    for name in MODEL_CTES:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({MODEL_CTES[n]})" for n in used)
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if m:
        head = "WITH RECURSIVE" if m.group(1) else "WITH"
        return f"{head} {ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
