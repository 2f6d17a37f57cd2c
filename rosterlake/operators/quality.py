"""Declared constraints as Spark jobs (Q1-Q19).

CHECK semantics: a row violates a rule only if the predicate is *false*; NULL
passes. Every table is checked in one pass (one ``count_if`` per rule); the
report is long rows (tabella, vincolo, tipo, violazioni).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The CHECK rules (table, name, SQL predicate).
CHECKS = (
    ("giocatori", "ruolo_check", "ruolo IN ('P','D','C','A')"),
    ("giocatori", "quotazione_iniziale_pos", "quotazione_iniziale >= 0"),
    ("giocatori", "quotazione_attuale_pos", "quotazione_attuale >= 0"),
    ("mia_rosa", "ruolo_fanta_check", "ruolo_fanta IN ('P','D','C','A')"),
    ("mia_rosa", "prezzo_pagato_pos", "prezzo_pagato >= 0"),
    ("statistiche_storiche", "presenze_pos", "presenze >= 0"),
    ("statistiche_storiche", "gol_pos", "gol >= 0"),
    ("statistiche_storiche", "assist_pos", "assist >= 0"),
    ("voti_giornata", "giornata_range", "giornata BETWEEN 1 AND 38"),
    ("voti_giornata", "voti_gol_pos", "gol >= 0"),
    ("voti_giornata", "voti_assist_pos", "assist >= 0"),
    ("squadre", "budget_pos", "budget_totale > 0"),
    ("asta_log", "prezzo_finale_pos", "prezzo_finale >= 0"),
    ("calendario", "cal_giornata_range", "giornata BETWEEN 1 AND 38"),
    ("formazioni_probabili", "form_giornata_range", "giornata BETWEEN 1 AND 38"),
)
# NOT NULL columns per table.
NOT_NULL = {
    "giocatori": ("nome", "ruolo", "squadra"),
    "statistiche_storiche": ("giocatore_id", "stagione"),
    "squadre": ("nome", "budget_totale"),
    "voti_giornata": ("giornata", "stagione"),
    "calendario": ("giornata", "squadra_casa", "squadra_trasferta", "stagione"),
    "formazioni_probabili": ("giornata", "squadra"),
}
# Unique keys and the child tables that reference giocatori(id).
UNIQUE_KEYS = (
    ("giocatori", "fanta_id", ("fanta_id",)),
    ("giocatori", "nome_squadra", ("nome", "squadra")),
    ("statistiche_storiche", "giocatore_stagione", ("giocatore_id", "stagione")),
    ("voti_giornata", "giocatore_giornata_stagione", ("giocatore_id", "giornata", "stagione")),
    ("squadre", "nome", ("nome",)),
)
PLAYER_CHILDREN = ("statistiche_storiche", "voti_giornata", "mia_rosa", "asta_log")


def _violated(expr: str) -> F.Column:
    return ~F.coalesce(F.expr(expr), F.lit(True))


def rules_of(table: str) -> list[tuple[str, str, str]]:
    """(name, kind, predicate-that-must-hold) for one table."""
    out = [(name, "check", expr) for t, name, expr in CHECKS if t == table]
    out += [(f"{c}_not_null", "not_null", f"{c} IS NOT NULL") for c in NOT_NULL.get(table, ())]
    return out


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violation counts of every CHECK and NOT NULL rule, one pass per table."""
    out = None
    for table, df in tables.items():
        rules = rules_of(table)
        if not rules:
            continue
        counts = df.agg(*[F.count_if(_violated(expr)).alias(f"_v{i}") for i, (_, _, expr) in enumerate(rules)])
        stack = "stack({n}, {rows}) as (vincolo, tipo, violazioni)".format(
            n=len(rules), rows=", ".join(f"'{name}', '{kind}', _v{i}" for i, (name, kind, _) in enumerate(rules)))
        part = counts.select(F.lit(table).alias("tabella"), F.expr(stack))
        out = part if out is None else out.unionByName(part)
    return out


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken rules."""
    rules = rules_of(table)
    broken = F.filter(F.array(*[F.when(_violated(expr), F.lit(name)) for name, _, expr in rules]),
                      lambda x: x.isNotNull())
    return df.withColumn("violati", broken).where(F.size("violati") > 0)


def clean_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows passing every rule (the complement of ``violations``)."""
    ok = F.lit(True)
    for _, _, expr in rules_of(table):
        ok = ok & ~_violated(expr)
    return df.where(ok)


def fk_orphans(children: dict[str, DataFrame], giocatori: DataFrame) -> DataFrame:
    """Per child table: rows whose non-NULL giocatore_id has no player (Q17)."""
    ids = giocatori.select(F.col("id").alias("_pid")).distinct()
    out = None
    for table, df in children.items():
        orphans = (df.where(F.col("giocatore_id").isNotNull())
                   .join(ids, F.col("giocatore_id") == ids._pid, "left_anti"))
        part = orphans.agg(F.count(F.lit(1)).alias("orfani")).select(F.lit(table).alias("tabella"), "orfani")
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Key values held by more than one row (Q18); NULL keys are left out."""
    out = None
    for table, name, cols in UNIQUE_KEYS:
        if table not in tables:
            continue
        df = tables[table]
        not_null = F.lit(True)
        for c in cols:
            not_null = not_null & F.col(c).isNotNull()
        dup = (df.where(not_null).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1))
        part = dup.select(F.lit(table).alias("tabella"), F.lit(name).alias("vincolo"),
                          F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("chiave"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def missing_columns(columns, required) -> set[str]:
    """Required source columns absent from a header (Q19): a driver-side set."""
    return set(required) - set(columns)
