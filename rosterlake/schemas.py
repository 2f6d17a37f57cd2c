"""Table schemas of the league model (I6) and their partitioning."""

from __future__ import annotations

from pyspark.sql.types import StructType

SCHEMA_DDL: dict[str, str] = {
    "giocatori": "id long, fanta_id long, nome string, ruolo string, squadra string, "
                 "quotazione_iniziale double, quotazione_attuale double, fvm double, "
                 "creato_il timestamp, aggiornato_il timestamp",
    "statistiche_storiche": "id long, giocatore_id long, stagione string, presenze int, gol int, "
                            "assist int, media_voto double, fantamedia double, gol_subiti int, "
                            "rigori_parati int, rigori_calciati int, bonus int, malus int, autogol int, "
                            "ammonizioni int, espulsioni int",
    "squadre": "id long, nome string, allenatore string, budget_totale double, creato_il timestamp",
    "asta_log": "id long, giocatore_id long, prezzo_finale double, squadra_acquirente string, "
                "fonte string, creato_il timestamp",
    "mia_rosa": "id long, giocatore_id long, prezzo_pagato double, ruolo_fanta string, "
                "acquistato_il timestamp",
    "voti_giornata": "id long, giocatore_id long, giornata int, stagione string, voto double, "
                     "fantavoto double, gol int, assist int, ammonizione boolean, espulsione boolean",
    "calendario": "id long, giornata int, squadra_casa string, squadra_trasferta string, "
                  "data_partita timestamp, stagione string",
    "formazioni_probabili": "id long, giornata int, squadra string, modulo string, "
                            "titolari array<string>, fonte string, creato_il timestamp",
    "app_logs": "ts timestamp, level string, message string, extra string, app_name string",
    "documents": "id string, document string, giocatore_id long",
}


def schema_of(name: str) -> StructType:
    """The table's StructType (parsed on use: parsing DDL needs a live session)."""
    return StructType.fromDDL(SCHEMA_DDL[name])


# Season-keyed tables are partitioned by season so that season filters prune
# files and a season's re-import rewrites only its own partition.
PARTITION_BY: dict[str, tuple[str, ...]] = {
    "statistiche_storiche": ("stagione",),
    "voti_giornata": ("stagione",),
}
