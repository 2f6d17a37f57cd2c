"""Upsert without a transactional table format.

One generic operator: a full outer join of target and source on the key with
presence flags; matched rows take the update columns from the source, new rows
take every column from the source (or a default), target-only rows are kept.
``=`` semantics: a NULL key never matches, so it is always inserted.

Duplicate source keys are resolved *last wins* by an ordinal column with a
``max_by`` aggregate (partial aggregation: a key repeated a million times is
collapsed map-side, never windowed in one task), or refused (``unique_keys``). The
result is a new snapshot DataFrame plus an ``azione`` column; writing it is
``rosterlake.sinks``.

Tables whose new rows need ids go through ``merge_numbered``: the source is stored
once, its rows without a partner in the target are numbered from the target's
greatest id and stored (the delta), and the target's rows take their new values by
one left join. Target rows are read for their keys and once for the result; nothing
is computed for them twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.plans.broadcast import broadcast_bounded
from rosterlake.sinks import tables

# Action labels of the merge report.
INSERTED, UPDATED, KEPT = "inserito", "aggiornato", "invariato"


def dedupe_last_wins(source: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per non-NULL key: the one with the greatest ``ordinal``.
    Rows with a NULL key part are never merged with each other."""
    has_key = _all_set(keys)
    others = [c for c in source.columns if c not in keys]
    last = (source.where(has_key).groupBy(*keys)
            .agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]))
    return last.unionByName(source.where(~has_key))


def unique_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source as it is, one row per non-NULL key (M13, strict): a key that occurs
    twice fails the query, as a transactional merge with two matching rows does."""
    has_key = _all_set(keys)
    others = [c for c in source.columns if c not in keys]
    message = F.concat_ws(" ", F.lit(f"repeated merge key ({', '.join(keys)}):"), *[F.col(k).cast("string") for k in keys])
    once = source.where(has_key).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_row"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return (once.withColumn("_row", row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
            .unionByName(source.where(~has_key)))


def _all_set(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def merge(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
          insert_values: dict[str, Column] | None = None,
          update_values: dict[str, Column] | None = None) -> DataFrame:
    """Upsert ``source`` into ``target`` on ``keys``.

    - matched: ``update_cols`` from the source, ``update_values`` expressions
      (evaluated over source columns ``s.*``), the rest kept;
    - source only: source columns, with ``insert_values`` for the others;
    - target only: kept as is.
    A NULL key matches nothing; such rows are spread by a hash of the whole row, so
    that the join doesn't send them all to one task. Adds ``azione`` (inserito /
    aggiornato / invariato).
    """
    insert_values = insert_values or {}
    update_values = update_values or {}
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = lambda df: F.when(no_key, F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long"))
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("_in_t"),
                      spread(target).alias("_spread_t"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("_in_s"),
                      spread(source).alias("_spread_s"))
    cond = reduce(lambda a, b: a & b, [t[f"t_{k}"] == s[f"s_{k}"] for k in keys]) & (t._spread_t == s._spread_s)
    j = t.join(s, cond, "full_outer")
    in_t = F.coalesce(F.col("_in_t"), F.lit(False))
    in_s = F.coalesce(F.col("_in_s"), F.lit(False))
    matched = in_t & in_s
    cols = []
    for col in target.columns:
        src = F.col(f"s_{col}") if col in source.columns else None
        new_val = insert_values.get(col, src if src is not None else F.lit(None))
        if col in update_values:
            upd = update_values[col]
        elif col in update_cols and src is not None:
            upd = src
        else:
            upd = F.col(f"t_{col}")
        value = (F.when(matched, upd).when(in_s, new_val).otherwise(F.col(f"t_{col}")))
        cols.append(value.cast(target.schema[col].dataType).alias(col))
    action = F.when(matched, F.lit(UPDATED)).when(in_s, F.lit(INSERTED)).otherwise(F.lit(KEPT))
    return j.select(*cols, action.alias("azione"))


def merge_numbered(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str], id_col: str = "id",
                   insert_values: dict[str, Column] | None = None,
                   update_values: dict[str, Column] | None = None) -> DataFrame:
    """``merge`` with ids for the inserted rows (M9): max(id) of the target + rank by
    the keys. Source and inserted rows are stored in the shared folder while this is
    called; the result reads the target's rows once."""
    insert_values, update_values = insert_values or {}, update_values or {}
    source = tables.materialize(source, "merge-source")
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    t_keys, s_keys = [f"t_{k}" for k in keys], [f"s_{k}" for k in keys]
    t_set, s_set = _all_set(t_keys), _all_set(s_keys)
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(t_keys, s_keys)])

    def column(c: str, values: dict[str, Column], wanted) -> Column:
        src = F.col(f"s_{c}") if c in source.columns else F.lit(None)
        return (values[c] if c in values else src if wanted(c) else F.col(f"t_{c}")).cast(target.schema[c].dataType)

    # rows with a NULL key match nothing: they never go through a join
    partnerless = s.where(s_set).join(t.where(t_set).select(*t_keys), same, "left_anti").unionByName(s.where(~s_set))
    fresh = partnerless.select(*[(F.lit(None).cast(target.schema[c].dataType) if c == id_col else column(c, insert_values, lambda _: True)).alias(c)
                                 for c in target.columns])
    base = target.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()          # scalar subquery over one column
    fresh = number_rows(fresh, id_col, keys, base)

    met = F.col("_met").isNotNull()
    update = lambda c: c in update_cols and c in source.columns
    joined = t.where(t_set).join(s.where(s_set).withColumn("_met", F.lit(True)), same, "left")
    kept = joined.select(*[(F.when(met, column(c, update_values, update)).otherwise(F.col(f"t_{c}"))
                            if c in update_values or update(c) else F.col(f"t_{c}")).alias(c) for c in target.columns],
                         F.when(met, F.lit(UPDATED)).otherwise(F.lit(KEPT)).alias("azione"))
    still = t.where(~t_set).select(*[F.col(f"t_{c}").alias(c) for c in target.columns], F.lit(KEPT).alias("azione"))
    return kept.unionByName(still).unionByName(fresh.withColumn("azione", F.lit(INSERTED)))


_LOCAL = 33                                   # bits of the row number in monotonically_increasing_id


def number_rows(rows: DataFrame, id_col: str, order_cols: list[str], base: Column, num_partitions: int | None = None) -> DataFrame:
    """``rows`` with ``id_col`` = base + dense rank by ``order_cols`` (rows equal there by a
    hash of the whole row), whatever the partitioning.

    No single-partition window and no window at all: the rows are range partitioned,
    sorted within partitions and stored with their place in the partition, so that
    place and counts agree whenever they are read; one count per partition (bounded)
    gives each its offset."""
    order = [*order_cols, F.xxhash64(*[c for c in rows.columns if c != id_col])]
    ranged = rows.repartitionByRange(num_partitions, *order) if num_partitions else rows.repartitionByRange(*order)
    placed = tables.materialize(ranged.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_row", _LOCAL)
    place = F.col("_row").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    parts = num_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offsets = broadcast_bounded(offsets, parts, "one row per partition")
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn(id_col, (base + F.col("_offset") + place + 1).cast(rows.schema[id_col].dataType)).select(*rows.columns))


def assign_ids(merged: DataFrame, id_col: str, order_cols: list[str],
               num_partitions: int | None = None) -> DataFrame:
    """Fill the NULL ids of an already merged table with max(id) + rank by ``order_cols``
    (M9). Reads ``merged`` three times: store it first, or use ``merge_numbered``."""
    base = merged.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    need = number_rows(merged.where(F.col(id_col).isNull()), id_col, order_cols, base, num_partitions)
    return merged.where(F.col(id_col).isNotNull()).unionByName(need)


def merge_report(merged: DataFrame) -> DataFrame:
    """Count per action."""
    return merged.groupBy("azione").agg(F.count(F.lit(1)).alias("n"))


def sync_removed(target: DataFrame, file_ids: DataFrame, key: str = "fanta_id") -> DataFrame:
    """Target rows whose non-NULL key is not among the file's ids (M11 report)."""
    ids = file_ids.select(F.col(key).alias("_fid")).where(F.col("_fid").isNotNull()).distinct()
    return target.where(F.col(key).isNotNull()).join(ids, F.col(key) == ids._fid, "left_anti")


def sync_keep(target: DataFrame, file_ids: DataFrame, key: str = "fanta_id") -> DataFrame:
    """Target rows that stay: key in the file, or NULL key."""
    ids = file_ids.select(F.col(key).alias("_fid")).where(F.col("_fid").isNotNull()).distinct()
    return (target.join(ids, F.col(key) == ids._fid, "left_semi")
            .unionByName(target.where(F.col(key).isNull())))


def cascade(child: DataFrame, remaining_players: DataFrame, fk: str = "giocatore_id",
            pk: str = "id") -> DataFrame:
    """Child rows that survive a delete of their player (M12); NULL fk kept."""
    ids = remaining_players.select(F.col(pk).alias("_pk")).distinct()
    return (child.join(ids, F.col(fk) == ids._pk, "left_semi")
            .unionByName(child.where(F.col(fk).isNull())))


# The 13 measures a season re-import overwrites.
STAT_MEASURES = ("presenze", "media_voto", "fantamedia", "gol", "gol_subiti", "rigori_parati",
                 "rigori_calciati", "bonus", "malus", "assist", "ammonizioni", "espulsioni", "autogol")


def upsert_stats(target: DataFrame, imported: DataFrame) -> DataFrame:
    """Season statistics upsert on (giocatore_id, stagione) (M3). ``imported``
    are the ``importato`` rows of the season transform. Write the result with
    ``sinks.tables.write_table(..., "statistiche_storiche", ...)``: only the
    touched seasons' partitions are rewritten."""
    cols = ["giocatore_id", "stagione", *STAT_MEASURES]
    return merge(target, imported.select(*cols), ["giocatore_id", "stagione"], list(STAT_MEASURES))


def stats_import_report(transformed: DataFrame, target: DataFrame) -> DataFrame:
    """Rows inserted / updated / skipped / incomplete of a season import (M14),
    a real split of insert and update."""
    ok = transformed.where(F.col("esito") == "importato")
    merged = upsert_stats(target, ok)
    done = (merged.where(F.col("azione") != KEPT).groupBy(F.col("azione").alias("voce"))
            .agg(F.count(F.lit(1)).alias("n")))
    rest = (transformed.where(F.col("esito") != "importato").groupBy(F.col("esito").alias("voce"))
            .agg(F.count(F.lit(1)).alias("n")))
    return done.unionByName(rest)


def census_upsert(squadre: DataFrame, entries: DataFrame, budget_totale: float) -> DataFrame:
    """Team census (M4): names trimmed, coach trimmed (NULL stays NULL), one
    merge for the whole list; a rerun with another budget updates every team. Of
    repeated names the last by ``_ordinal`` wins, without that column the greatest
    coach; entries without a name name no team and are left out."""
    order = [F.col("_ordinal")] if "_ordinal" in entries.columns else []
    src = entries.select(F.trim("nome").alias("nome"),
                         F.struct(*order, F.trim("allenatore").alias("allenatore")).alias("_last")).where("nome is not null")
    src = src.groupBy("nome").agg(F.max("_last").alias("_last")).select(
        "nome", "_last.allenatore", F.lit(float(budget_totale)).alias("budget_totale"))
    return merge(squadre, src, ["nome"], ["allenatore", "budget_totale"])


# Per table, the merge key and the columns a match overwrites.
MERGE_SPECS = {
    "giocatori": (("fanta_id",), ("nome", "ruolo", "squadra", "quotazione_iniziale",
                                  "quotazione_attuale", "fvm")),                       # M1
    "statistiche_storiche": (("giocatore_id", "stagione"), STAT_MEASURES),              # M3
    "squadre": (("nome",), ("allenatore", "budget_totale")),                            # M4
    "voti_giornata": (("giocatore_id", "giornata", "stagione"),
                      ("voto", "fantavoto", "gol", "assist", "ammonizione", "espulsione")),  # M5
    "asta_log": (("giocatore_id",), ("prezzo_finale", "squadra_acquirente", "fonte")),  # M6
    "mia_rosa": (("giocatore_id",), ("prezzo_pagato", "ruolo_fanta")),                  # M7
    "calendario": (("giornata", "squadra_casa", "stagione"), ("squadra_trasferta", "data_partita")),  # M8
    "formazioni_probabili": (("giornata", "squadra"), ("modulo", "titolari", "fonte")),  # M10
}
# columns stamped with the merge time: (on update, on insert)
STAMPS = {
    "giocatori": ("aggiornato_il", "creato_il"),
    "formazioni_probabili": ("creato_il", "creato_il"),
}


def upsert(table: str, target: DataFrame, source: DataFrame, now=None, numbered: bool = False, strict: bool = False) -> DataFrame:
    """Upsert by the table's merge spec (M1-M10). ``now`` (a timestamp literal,
    passed in for repeatable runs) stamps the update/insert time columns. ``numbered``
    gives inserted rows their ids; ``strict`` refuses repeated source keys (M13)."""
    keys, update = MERGE_SPECS[table]
    if strict:
        source = unique_keys(source, list(keys))
    upd, ins = {}, {}
    if now is not None and table in STAMPS:
        on_update, on_insert = STAMPS[table]
        upd[on_update] = F.lit(now)
        ins[on_insert] = F.lit(now)
        if on_update != on_insert:
            ins[on_update] = F.lit(now)
    update_cols = [c for c in update if c not in upd]
    return (merge_numbered if numbered else merge)(target, source, list(keys), update_cols, insert_values=ins, update_values=upd)


def cascade_report(children: dict[str, DataFrame], target: DataFrame, file_ids: DataFrame,
                   key: str = "fanta_id", fk: str = "giocatore_id", pk: str = "id") -> DataFrame:
    """Per child table: rows a sync would delete with their player, and rows
    that stay (M12). One player-status table (removed / kept), then a single
    left join and one aggregate per child. Rows whose player is not in the
    target at all are neither."""
    ids = file_ids.select(F.col(key).alias("_fid")).where(F.col("_fid").isNotNull()).distinct()
    status = (target.join(ids, target[key] == ids._fid, "left")
              .select(F.col(pk).alias("_pk"),
                      (F.col(key).isNotNull() & F.col("_fid").isNull()).alias("_removed")))
    out = None
    for table, child in children.items():
        j = child.select(fk).join(status, F.col(fk) == status._pk, "left")
        part = j.agg(
            F.count_if(F.col("_removed")).alias("rimosse"),
            F.count_if(F.col(fk).isNull() | ~F.col("_removed")).alias("mantenute"),
        ).select(F.lit(table).alias("tabella"), "rimosse", "mantenute")
        out = part if out is None else out.unionByName(part)
    return out


def upsert_players_from_csv(players: DataFrame, csv_rows: DataFrame, now=None) -> DataFrame:
    """M2: the hand-made CSV (nome, ruolo, squadra, quotazione, _ordinal) keyed
    on (nome, squadra): a match updates only quotazione_attuale; a new player
    gets both quotations from the file, fanta_id and fvm stay NULL. Repeated
    rows of the file: last wins. New players need ids: ``assign_ids``."""
    src = dedupe_last_wins(csv_rows, ["nome", "squadra"], "_ordinal").drop("_ordinal")
    q = F.col("s_quotazione")
    ins = {"quotazione_iniziale": q, "quotazione_attuale": q}
    upd = {"quotazione_attuale": q}
    if now is not None and "aggiornato_il" in players.columns:
        upd["aggiornato_il"] = F.lit(now)
        ins["aggiornato_il"] = F.lit(now)
        if "creato_il" in players.columns:
            ins["creato_il"] = F.lit(now)
    return merge(players, src, ["nome", "squadra"], [], insert_values=ins, update_values=upd)
