"""Live purchase admission (T1): the X9 fold as a stateful stream.

Attempts arrive as a stream; the census and the player table are static and joined
stream-static. ``transformWithStateInPandas`` keeps, per team, the cents spent so
far in RocksDB (``ValueState``, no timeout: a budget never expires). The purchases made
before the stream first started are its *initial state*, read in the first batch
only: what the stream accepts itself is in the state, so a restart never counts it
again, also when the accepted rows were appended to asta_log meanwhile.

A team's attempts come in frames of bounded size, judged one after another and never
held together. Within a frame they are ordered by (ts, id); frames and micro-batches
are judged as they arrive (a late attempt is judged when it comes, as in the
source app), so a team is in (ts, id) order as long as its attempts of one
micro-batch fit a frame (``spark.sql.execution.arrow.maxRecordsPerBatch``) or come
sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rosterlake.operators.auction import (ATTEMPT_COLUMNS, RESULT_SCHEMA, TEAM, enrich_attempts, fold_block, spent_by_team,
                                          with_verdict)
from rosterlake.session import ship_package

STATE_SCHEMA = StructType([StructField("spent_c", LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FLAGS = ["_price_c", "_team_ok", "_fault", "_player_ok"]


class Admission(StatefulProcessor):
    """Residual before each attempt of a team, from the cents it has spent. ``columns`` names
    the frames' columns by place: computed ones arrive under other names."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spent = self._spent()
        for frame in rows:
            frame = frame.set_axis(self.columns, axis=1).sort_values(["ts", "id"], kind="stable")
            budget = int(frame["_budget_c"].iloc[0])
            _, before, left = fold_block(frame["_price_c"].to_numpy(), frame["_pays"].to_numpy(dtype=bool), budget - spent)
            spent = budget - left
            out = frame[[*ATTEMPT_COLUMNS, *_FLAGS]].copy()
            out["_before"] = before
            yield out
        self.spent.update((spent,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.spent.update((int(initialState.iloc[0, -1]),))

    def close(self) -> None:
        pass

    def _spent(self) -> int:
        return int(self.spent.get()[0]) if self.spent.exists() else 0


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that this stream needs, where the session names none of its own."""
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)


def admission_stream(attempts: DataFrame, census: DataFrame, giocatori: DataFrame,
                     ledger: DataFrame | None = None) -> DataFrame:
    """Streaming DataFrame of judged attempts (append mode). ``ledger`` is the asta_log;
    it counts in the first batch of a checkpoint only."""
    spark = attempts.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    e = enrich_attempts(attempts, census, giocatori)
    initial = None if ledger is None else spent_by_team(ledger).select(TEAM, "_spent_c").where("_spent_c is not null").groupBy(TEAM)
    kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    out = ", ".join([*(f"{c} {kinds[c]}" for c in [*ATTEMPT_COLUMNS, *_FLAGS]), "_before long"])
    judged = e.groupBy(TEAM).transformWithStateInPandas(
        Admission(e.columns), outputStructType=out, outputMode="append", timeMode="none", initialState=initial)
    verdict = with_verdict(judged)
    assert [f.name for f in StructType.fromDDL(RESULT_SCHEMA).fields] == verdict.columns
    return verdict


def start_admission(attempts: DataFrame, census: DataFrame, giocatori: DataFrame, judged_path: str,
                    checkpoint: str, available_now: bool = False,
                    trigger: str = "1 second", ledger: DataFrame | None = None) -> StreamingQuery:
    """Run T1 and append every judged attempt to ``judged_path`` (exactly once
    through the checkpoint); accepted rows are the asta_log appends (I1)."""
    w = (admission_stream(attempts, census, giocatori, ledger).writeStream.format("parquet")
         .option("path", judged_path).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
