"""End-to-end ETL jobs: files -> transform -> merge -> new table snapshot.

``import_price_list``: price-list sheets (S2) -> X23 -> upsert players (M1,
last wins on repeated ids, new ids M9) -> optional sync (M11) with cascade to
the child tables (M12) -> report (M14).

``import_season_stats``: season sheets of any number of files (S3, S4) -> X24
-> upsert on (player, season) (M3) -> report. The result is a complete snapshot
(``out_path`` new), or, with ``in_place``, only the imported seasons' partitions of
the table that is already at ``out_path`` are rewritten.

Snapshots are written to paths given by the caller, which must differ from the
tables being read: Spark reads lazily, so overwriting an input in place would
read a half-written table. Reports count the rows while they are written
(``Observation``): no second merge runs, and what happens to the inputs later
doesn't change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import etl, merge
from rosterlake.sinks import tables
from rosterlake.sources import sheets


# Report entries of a sync and of rows that can't be read.
REMOVED, REJECTED = "rimosso", "scartato"


def _written(df: DataFrame, name: str, path: str, counts: dict[str, Column], drop: tuple[str, ...] = ()) -> dict[str, int]:
    """Write a table and return what ``counts`` come to over the written rows."""
    seen = Observation(f"written-{name}")
    watched = df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()])
    tables.write_table(watched.drop(*drop), name, path)
    return {k: int(v) for k, v in seen.get.items()}


def _report(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(voce, n), the entries that occur."""
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "voce string, n long")


def _actions() -> dict[str, Column]:
    return {a: F.count_if(F.col("azione") == a) for a in (merge.UPDATED, merge.INSERTED, merge.KEPT)}


def import_price_list(spark: SparkSession, paths, players: DataFrame, out_path: str,
                      budget_lega: int = etl.FVM_REFERENCE_BUDGET, sync: bool = False, strict: bool = False,
                      children: dict[str, DataFrame] | None = None,
                      children_out: dict[str, str] | None = None, now=None) -> DataFrame:
    """Import price lists into a new players snapshot at ``out_path``; returns
    the report rows (voce, n). With ``sync``, players missing from the files
    are removed (NULL fanta_id kept) and their child rows are dropped from the
    ``children`` tables written to ``children_out``. Of rows with one id the last
    counts; ``strict`` fails on them. Rows with an unreadable number are reported
    and not imported."""
    raw = tables.materialize(sheets.scan_sheets(spark, paths, etl.PRICE_LIST_REQUIRED), "sheet")
    source = etl.price_list_transform(raw, budget_lega, ("_ordinal",))
    rejected = {REJECTED: etl.price_list_rejects(raw).count()}
    # sync goes by every Id of the files, also of rows that the transform skips
    listed = raw.select(etl.c("Id").try_cast("double").try_cast("long").alias("fanta_id")).where("fanta_id is not null")
    if sync and listed.limit(1).count() == 0:
        raise ValueError("empty price list with sync: refusing to delete every player")
    source = (merge.unique_keys(source, ["fanta_id"]) if strict else merge.dedupe_last_wins(source, ["fanta_id"], "_ordinal")).drop("_ordinal")
    merged = merge.upsert("giocatori", players, source, now, numbered=True)
    if not sync:
        return _report(spark, _written(merged, "giocatori", out_path, _actions(), ("azione",)) | rejected)
    # the players that go are a flag of the merged rows, counted where they are left out
    ids = tables.materialize(listed.distinct(), "listed")
    flagged = merged.join(ids.select(F.col("fanta_id").alias("_listed")), F.col("fanta_id") == F.col("_listed"), "left")
    gone = F.col("fanta_id").isNotNull() & F.col("_listed").isNull()
    seen = Observation("merged")
    counted = flagged.observe(seen, *[c.alias(k) for k, c in _actions().items()], F.count_if(gone).alias(REMOVED))
    tables.write_table(counted.where(~gone).drop("azione", "_listed"), "giocatori", out_path)
    # the cascade joins against the snapshot, not against a re-run of the merge
    kept = spark.read.parquet(out_path)
    for name, child in (children or {}).items():
        tables.write_table(merge.cascade(child, kept), name, (children_out or {})[name])
    return _report(spark, {k: int(v) for k, v in seen.get.items()} | rejected)


def import_season_stats(spark: SparkSession, paths, players: DataFrame, stats: DataFrame,
                        out_path: str, stagione_override: str | None = None, in_place: bool = False) -> DataFrame:
    """Import season sheets; returns the report rows (voce, n). The whole merged
    table goes to ``out_path``; with ``in_place`` the table there keeps its other seasons
    and only the imported ones are rewritten (``stats`` must be read from elsewhere)."""
    raw = sheets.scan_sheets(spark, paths, etl.STATS_REQUIRED)
    transformed = tables.materialize(
        etl.season_stats_transform(raw, players, etl.season_column(paths, stagione_override), ("_ordinal",)), "season-rows")
    seen = {r.esito: (r.n, r.unnamed) for r in transformed.groupBy("esito").agg(      # three states
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("stagione").isNull()).alias("unnamed")).collect()}
    if seen.get(etl.STATUS_OK, (0, 0))[1]:
        raise ValueError("season not found in the title or the file name: pass stagione_override")
    ok = transformed.where(F.col("esito") == etl.STATUS_OK)
    source = merge.dedupe_last_wins(ok.select("giocatore_id", "stagione", *merge.STAT_MEASURES, "_ordinal"),
                                    ["giocatore_id", "stagione"], "_ordinal").drop("_ordinal")
    merged = merge.upsert("statistiche_storiche", stats, source, numbered=True)
    if in_place:
        touched = ok.select(F.col("stagione").alias("_touched")).distinct()
        merged = merged.join(touched, F.col("stagione") == F.col("_touched"), "left_semi")
    done = _written(merged, "statistiche_storiche", out_path, _actions(), ("azione",))
    skipped = {s: n for s, (n, _) in seen.items() if s != etl.STATUS_OK}
    return _report(spark, {k: n for k, n in done.items() if k != merge.KEPT} | skipped)
