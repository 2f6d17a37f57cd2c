"""Time-driven feeds as Structured Streaming jobs.

- T2 ``log_sink``: log rows written to a Parquet table every ``trigger``; the
  checkpoint makes it exactly-once (nothing lost, nothing doubled after a
  restart), replacing a bounded in-memory buffer that dropped rows.
- T3 ``scoreboard``: spent amount and purchases per team, kept up to date as
  purchases arrive (update mode); residuals come from the static team table.
- T4 ``document_sync``: players that change (or whose seasons or roster place do) get
  their documents rebuilt and put into a document log, deleted players a tombstone;
  ``current_documents`` reads it last-wins per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlake.operators import changes
from rosterlake.operators.changes import current_documents  # noqa: F401  (part of this module's interface)

LOG_TRIGGER = "30 seconds"
SCOREBOARD_TRIGGER = "8 seconds"


def log_sink(logs: DataFrame, path: str, checkpoint: str, trigger: str | None = LOG_TRIGGER,
             available_now: bool = False) -> StreamingQuery:
    w = logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.outputMode("append").start()


def scoreboard(purchases: DataFrame) -> DataFrame:
    """Streaming aggregate: spent and count per buying team."""
    return purchases.groupBy("squadra_acquirente").agg(
        F.sum("prezzo_finale").alias("budget_speso"), F.count(F.lit(1)).alias("acquisti"))


def scoreboard_with_budget(board: DataFrame, squadre: DataFrame) -> DataFrame:
    """Apply to a scoreboard snapshot (e.g. inside ``foreachBatch``)."""
    j = squadre.join(board, squadre.nome == board.squadra_acquirente, "left")
    speso = F.coalesce(F.col("budget_speso"), F.lit(0.0))
    return j.select("nome", "budget_totale", speso.alias("budget_speso"),
                    (F.col("budget_totale") - speso).alias("budget_residuo"),
                    F.coalesce(F.col("acquisti"), F.lit(0)).alias("acquisti"))


def document_sync(changed: DataFrame, stats: DataFrame, mia_rosa: DataFrame, path: str,
                  checkpoint: str, available_now: bool = True, giocatori: DataFrame | None = None) -> StreamingQuery:
    """For every micro-batch of changes, put the players' documents into the log at ``path``.

    ``changed`` holds either whole player rows, or (with ``giocatori``, the table as it
    is now) only ids: of changed players, of seasons (``giocatore_id``) or of roster rows.
    A column ``change`` with ``delete`` removes the document. Of several rows of one
    player in a batch the last by ``aggiornato_il`` counts (then the greatest by the other
    columns). A replayed batch replaces what it wrote."""
    key = "id" if giocatori is None or "giocatore_id" not in changed.columns else "giocatore_id"

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        kind = F.col("change") if "change" in batch.columns else F.lit(changes.UPDATE)
        if giocatori is not None:
            rows = batch.select(F.col(key).alias("id"), kind.alias("change")).where("id is not null")
            players = giocatori
        else:
            order = sorted((c for c in batch.columns if c != "id"), key=lambda c: c != "aggiornato_il")
            players = (batch.groupBy("id").agg(F.max(F.struct(*order)).alias("_row"))
                       .select("id", "_row.*").select(*batch.columns))
            rows = players.select("id", kind.alias("change"))
        changes.write_changes(changes.document_changes(rows, players, stats, mia_rosa), path, batch_id)

    w = changed.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=SCOREBOARD_TRIGGER)
    return w.start()


def start_scoreboard(purchases: DataFrame, squadre: DataFrame, path: str, checkpoint: str,
                     trigger: str = SCOREBOARD_TRIGGER, available_now: bool = False) -> StreamingQuery:
    """Every trigger, write the team board (budget, spent, residual) as a
    new snapshot under ``path/batch=<id>``; readers take the newest batch."""

    def publish(board: DataFrame, batch_id: int) -> None:
        scoreboard_with_budget(board, squadre).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = (scoreboard(purchases).writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
