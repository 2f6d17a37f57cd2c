"""Change feed between two snapshots of a table, and the documents that follow it (T4).

Two snapshots are compared by key and row hashes: one full outer join of (key, two
64-bit hashes) per table, whatever its width. A player's document changes when the
player, one of its seasons or its place in my roster changes; the document of a
player that is gone becomes a *tombstone* in the document log. The log is
append-only, one folder a batch, written with overwrite: a batch that is replayed
replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import documents

INSERT, UPDATE, DELETE = "insert", "update", "delete"      # fixed values: kinds of change
BATCH, GONE = "_batch", "_deleted"


def _hashes(df: DataFrame, keys: list[str]) -> Column:
    rest = [F.col(c) for c in sorted(df.columns) if c not in keys]
    return F.struct(F.xxhash64(F.lit(1), *rest).alias("a"), F.xxhash64(F.lit(2), *reversed(rest)).alias("b"))


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of the rows that differ. Rows with one key are compared as a whole
    (order doesn't count, repetition does); a NULL key is a key like any other. Columns
    that only one side has count as changed."""
    if set(old.columns) != set(new.columns):
        both = [c for c in new.columns if c in old.columns]
        old, new = (df.select(*both, *[F.lit(None).cast("string").alias(f"_{c}") for c in df.columns if c not in both]) for df in (old, new))
    side = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(_hashes(df, keys))).alias(name))
    o, n = side(old, "_o"), side(new, "_n").select(*[F.col(k).alias(f"_new_{k}") for k in keys], "_n")
    same = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        same = here if same is None else same & here
    change = F.when(F.col("_o").isNull(), F.lit(INSERT)).when(F.col("_n").isNull(), F.lit(DELETE)).otherwise(F.lit(UPDATE))
    either = [F.when(F.col("_n").isNull(), F.col(k)).otherwise(F.col(f"_new_{k}")).alias(k) for k in keys]
    return o.join(n, same, "full_outer").where(~F.col("_o").eqNullSafe(F.col("_n"))).select(*either, change.alias("change"))


def changed_players(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(id, change) of the players whose document must follow, between two sets of
    snapshots ``giocatori``, ``statistiche_storiche``, ``mia_rosa``: ``delete`` where the
    player is gone, else ``update`` (also where a season or the roster changed) or ``insert``."""
    own = snapshot_changes(old["giocatori"], new["giocatori"], ["id"])
    parts = own.select(F.col("id"), "change")
    for name in ("statistiche_storiche", "mia_rosa"):
        touched = snapshot_changes(old[name], new[name], ["giocatore_id"]).select(F.col("giocatore_id").alias("id"), F.lit(None).cast("string").alias("change"))
        parts = parts.unionByName(touched)
    one = parts.where("id is not null").groupBy("id").agg(F.max("change").alias("change"))
    # a season of no player in the new table has no document
    there = new["giocatori"].select(F.col("id").alias("_there")).distinct()
    kept = one.join(there, F.col("id") == F.col("_there"), "left")
    return kept.where((F.col("change") == DELETE) | F.col("_there").isNotNull()).select("id", F.coalesce("change", F.lit(UPDATE)).alias("change"))


def document_changes(changes: DataFrame, giocatori: DataFrame, stats: DataFrame, mia_rosa: DataFrame) -> DataFrame:
    """Document log rows of ``changes`` (id, change): rebuilt documents, and tombstones
    for deleted players and for ids that are no players. Only the named players' rows
    are read."""
    ids = changes.groupBy(F.col("id").alias("_cid")).agg(F.max_by("change", F.when(F.col("change") == DELETE, 1).otherwise(0)).alias("change"))
    live = ids.where((F.col("change") != DELETE) | F.col("change").isNull()).select("_cid")
    g = giocatori.join(live, F.col("id") == F.col("_cid"), "left_semi")
    s = stats.join(live, F.col("giocatore_id") == F.col("_cid"), "left_semi")
    r = mia_rosa.join(live, F.col("giocatore_id") == F.col("_cid"), "left_semi")
    docs = documents.player_documents(g, s, r)
    gone = ids.join(docs.select(F.col("giocatore_id").alias("_did")), F.col("_cid") == F.col("_did"), "left_anti")
    tombs = gone.select(F.col("_cid").cast("string").alias("id"), F.lit(None).cast("string").alias("document"), F.col("_cid").alias("giocatore_id"))
    return docs.withColumn(GONE, F.lit(False)).unionByName(tombs.withColumn(GONE, F.lit(True)))


def write_changes(rows: DataFrame, path: str, batch: int) -> None:
    """Put a batch into the document log; replayed, it replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={int(batch)}")


def sync_documents(old: dict[str, DataFrame], new: dict[str, DataFrame], path: str, batch: int) -> None:
    """Bring the document log at ``path`` from one set of snapshots to the next."""
    rows = document_changes(changed_players(old, new), new["giocatori"], new["statistiche_storiche"], new["mia_rosa"])
    write_changes(rows, path, batch)


def current_documents(change_log: DataFrame) -> DataFrame:
    """Latest document per id (I5 upsert semantics) from the log, without tombstones; the
    greatest document where a batch holds several of one id."""
    gone = F.col(GONE) if GONE in change_log.columns else F.lit(False)
    row = F.struct(F.col(BATCH), gone.alias("gone"), F.col("document"), F.col("giocatore_id"))
    last = change_log.groupBy("id").agg(F.max(row).alias("d"))
    return last.where(~F.col("d.gone")).select("id", "d.document", "d.giocatore_id")
