"""Purchase admission under a running budget (X9) and the roster appends.

The rule is order dependent: a rejected purchase spends nothing, so a later,
cheaper one may still pass. A running sum is therefore wrong; it is a fold over
each team's attempts in (ts, id) order carrying the residual budget.

One path for teams of any size:

1. Attempts are enriched by ordinary joins, range partitioned and sorted by
   (team, ts, id) and stored as blocks: up to ``block_rows`` consecutive attempts of
   one team in a row of arrays. A team of a billion attempts is spread over as many
   tasks as its share of the rows.
2. Each block lists its *candidates*. Starting from the most that the team can have
   left anywhere (``ceiling``), an upper bound of the residual goes through the block:
   at a price ``p`` within the bound, whoever could pay has at most ``bound - p`` left
   and whoever couldn't had less than ``p``, so the bound becomes
   ``max(bound - p, min(bound, p - 1))``; a price above the bound is never paid and
   leaves it. Only prices within the bound are candidates: about a budget's worth of
   purchases, then new lowest prices. All others are rejected whatever went before.
3. The sequential pass streams a team's blocks in order and opens only those whose
   least candidate price fits the residual; it gives every block its starting
   residual. It sees a few candidates a block, never the attempts.
4. All blocks are judged in parallel from their starting residuals.

Money is compared in integer cents. Steps 2 and 4 are column expressions; Python
only packs sorted rows into arrays (without copying) and streams step 3. The
Structured Streaming form (``rosterlake.streaming.admission``) keeps the spent
amount in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.session import ship_package
from rosterlake.sinks import tables

# Rejection reasons.
REASON_TEAM = "squadra_non_censita"
REASON_BUDGET = "budget_insufficiente"
REASON_PLAYER = "giocatore_non_trovato"
# Rows that no fold can judge; they spend nothing.
REASON_PRICE = "prezzo_non_valido"
REASON_NO_BUDGET = "budget_non_valido"

ATTEMPT_COLUMNS = ["ts", "id", "giocatore_id", "prezzo_finale", "squadra_acquirente", "e_mio", "fonte"]
RESULT_SCHEMA = ("ts timestamp_ntz, id long, giocatore_id long, prezzo_finale double, "
                 "squadra_acquirente string, e_mio boolean, fonte string, "
                 "accepted boolean, reason string, residuo_prima double")

MONEY_SCALE = 100            # money is compared exactly, in integer cents
BLOCK_ROWS = 1024            # attempts of a team in one block
TEAM = "squadra_acquirente"
_ROW = [c for c in ATTEMPT_COLUMNS if c != TEAM]
_PACKED = [*_ROW, "_price_c", "_pays", "_fault", "_player_ok"]      # columns of a block's rows
_HEAD = [TEAM, "_budget_c", "_ceiling_c", "_team_ok"]               # what a block's rows have in common


def cents(c: Column) -> Column:
    return F.round(c * MONEY_SCALE).cast("long")


def fold_block(price_c: np.ndarray, pays: np.ndarray, residual: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Judge attempts in order from ``residual`` cents: (accepted, residual before each,
    residual at the end). ``pays`` marks attempts that spend their price if it fits."""
    n = len(price_c)
    accepted, before = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    for i, (p, ok) in enumerate(zip(price_c.tolist(), pays.tolist())):
        before[i] = residual
        if ok and p <= residual:
            accepted[i] = True
            residual -= p
    return accepted, before, residual


def with_verdict(judged: DataFrame) -> DataFrame:
    """Result columns from ``_before`` (residual cents before the attempt) and the flags."""
    fits = F.col("_price_c") <= F.col("_before")
    sound = F.col("_team_ok") & F.col("_fault").isNull()
    reason = (F.when(~F.col("_team_ok"), F.lit(REASON_TEAM)).when(F.col("_fault").isNotNull(), F.col("_fault"))
              .when(~fits, F.lit(REASON_BUDGET)).when(~F.col("_player_ok"), F.lit(REASON_PLAYER)))
    return judged.select(*ATTEMPT_COLUMNS, (sound & fits & F.col("_player_ok")).alias("accepted"), reason.alias("reason"),
                         F.when(sound, F.col("_before") / MONEY_SCALE).alias("residuo_prima"))


def enrich_attempts(attempts: DataFrame, census: DataFrame, giocatori: DataFrame,
                    ledger: DataFrame | None = None) -> DataFrame:
    """Attach the team budget and the two existence flags with equi-joins.

    The budget is what is left of it: the census budget less what the team has
    already spent in ``ledger`` (the stored asta_log), added up per team before
    the join. A NULL price or budget marks the row (``_fault``)."""
    c = census.select(F.col("nome").alias("_team"), F.col("budget_totale").alias("_budget"))
    if ledger is not None:
        c = c.join(spent_by_team(ledger).withColumnRenamed(TEAM, "_team"), "_team", "left")
    else:
        c = c.withColumn("_spent_c", F.lit(0).cast("long"))
    g = giocatori.select(F.col("id").alias("_gid")).distinct()
    a = attempts.select(*ATTEMPT_COLUMNS)
    j = (a.join(c, a.squadra_acquirente == c._team, "left")
         .join(g, a.giocatore_id == g._gid, "left"))
    out = j.select(*ATTEMPT_COLUMNS,
                   F.coalesce(cents(F.col("prezzo_finale")), F.lit(0).cast("long")).alias("_price_c"),
                   (F.coalesce(cents(F.col("_budget")), F.lit(0).cast("long"))
                    - F.coalesce(F.col("_spent_c"), F.lit(0).cast("long"))).alias("_budget_c"),
                   F.when(F.col("_team").isNotNull() & F.col("_budget").isNull(), REASON_NO_BUDGET)
                   .when(F.col("prezzo_finale").isNull() | F.isnan("prezzo_finale"), REASON_PRICE).alias("_fault"),
                   F.col("_team").isNotNull().alias("_team_ok"),
                   F.col("_gid").isNotNull().alias("_player_ok"))
    return out.withColumn("_pays", F.col("_team_ok") & F.col("_player_ok") & F.col("_fault").isNull())


def spent_by_team(ledger: DataFrame) -> DataFrame:
    """Cents spent per team in the stored purchases."""
    return (ledger.where(F.col(TEAM).isNotNull()).groupBy(TEAM)
            .agg(F.sum(cents(F.col("prezzo_finale"))).alias("_spent_c")))


def _blocks(enriched: DataFrame, gains: DataFrame, block_rows: int) -> DataFrame:
    """The attempts as stored blocks, in order by ``_block``: range partitions are numbered
    in order, and so are the blocks in each. ``gains``: what negative prices can add to
    a team's residual."""
    rows = enriched.join(gains, TEAM, "left").withColumn(
        "_ceiling_c", F.greatest(F.col("_budget_c"), F.lit(0)) + F.coalesce(F.col("_gain_c"), F.lit(0)))
    ranged = (rows.select(*_HEAD, *_PACKED).repartitionByRange(TEAM, "ts", "id").sortWithinPartitions(TEAM, "ts", "id"))
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in _HEAD), f"_rows array<struct<{','.join(f'{c}:{kinds[c]}' for c in _PACKED)}>>"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            team = batch.column(0).dictionary_encode()
            code = np.asarray(team.indices.fill_null(-1))
            edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ends = np.append(edge[1:], n)
            start = np.concatenate([np.arange(a, b, block_rows) for a, b in zip(edge.tolist(), ends.tolist())])
            row = pa.StructArray.from_arrays([batch.column(len(_HEAD) + k) for k in range(len(_PACKED))], names=_PACKED)
            packed = pa.ListArray.from_arrays(pa.array(np.append(start, n).astype(np.int32)), row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(start)) for k in range(len(_HEAD))), packed], names=[*_HEAD, "_rows"])

    packed = ranged.mapInArrow(pack, schema)
    return tables.materialize(packed.withColumn("_block", F.monotonically_increasing_id()), "admission")


def _candidates(rows: Column, ceiling: Column) -> Column:
    """Prices of a block that anyone could pay, in order (step 2)."""
    start = F.struct(ceiling.alias("bound"), F.array().cast("array<bigint>").alias("prices"))

    def step(acc: Column, row: Column) -> Column:
        p, bound = row["_price_c"], acc["bound"]
        rest = F.greatest(bound - p, F.least(bound, p - 1))
        met = row["_pays"] & (p <= bound)
        return F.struct(F.when(met, rest).otherwise(bound).alias("bound"),
                        F.when(met, F.array_append(acc["prices"], p)).otherwise(acc["prices"]).alias("prices"))

    return F.aggregate(rows, start, step, lambda acc: acc["prices"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows sorted by (team, block): block, residual at its start."""
    team, residual = None, 0
    for batch in batches:
        out = np.empty(batch.num_rows, dtype=np.int64)
        teams, budgets, leasts = (batch.column(k).to_pylist() for k in (0, 1, 2))
        prices = batch.column(3)
        for i, name in enumerate(teams):
            if i == 0 and team is None or name != team:
                team, residual = name, budgets[i]
            out[i] = residual
            if leasts[i] is not None and leasts[i] <= residual:
                for p in prices[i].as_py():
                    if p <= residual:
                        residual -= p
        yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(out)], names=["_block", "_start_c"])


def _residuals(rows: Column, start: Column) -> Column:
    """Residual before each row of a block (step 4)."""
    begin = F.struct(start.alias("left"), F.array().cast("array<bigint>").alias("before"))

    def step(acc: Column, row: Column) -> Column:
        p, left = row["_price_c"], acc["left"]
        return F.struct(F.when(row["_pays"] & (p <= left), left - p).otherwise(left).alias("left"),
                        F.array_append(acc["before"], left).alias("before"))

    return F.aggregate(rows, begin, step, lambda acc: acc["before"])


def purchase_admission(attempts: DataFrame, census: DataFrame, giocatori: DataFrame,
                       num_partitions: int | None = None, block_rows: int = BLOCK_ROWS,
                       ledger: DataFrame | None = None) -> DataFrame:
    """Judge every attempt: accepted, reason, residual before the attempt.

    ``ledger`` holds the purchases already made (asta_log): a team starts with
    its budget less their sum, so two batches in a row judge as one would. The
    blocks are stored when this is called; the result doesn't depend on how the
    attempts fall into them.
    """
    ship_package(attempts.sparkSession)
    gains = (attempts.where("prezzo_finale < 0").groupBy(TEAM)
             .agg((-F.sum(cents(F.col("prezzo_finale")))).alias("_gain_c")))
    blocks = _blocks(enrich_attempts(attempts, census, giocatori, ledger), gains, block_rows)
    heads = blocks.select(TEAM, "_budget_c", _candidates(F.col("_rows"), F.col("_ceiling_c")).alias("_prices"), "_block")
    heads = heads.select(TEAM, "_budget_c", F.array_min("_prices").alias("_least"), "_prices", "_block")
    ordered = heads.repartition(num_partitions, TEAM) if num_partitions else heads.repartition(TEAM)
    starts = ordered.sortWithinPartitions(TEAM, "_block").mapInArrow(_starts, "_block long, _start_c long")
    judged = blocks.join(starts, "_block").select(
        TEAM, "_team_ok", F.explode(F.arrays_zip("_rows", _residuals(F.col("_rows"), F.col("_start_c")).alias("before"))).alias("_r"))
    return with_verdict(judged.select(TEAM, "_team_ok", "_r._rows.*", F.col("_r.before").alias("_before")))


def accepted_purchases(judged: DataFrame) -> DataFrame:
    """Rows to append to asta_log."""
    return judged.where("accepted").select(
        "id", "giocatore_id", "prezzo_finale", "squadra_acquirente", "fonte",
        F.col("ts").alias("creato_il"))


def my_new_players(judged: DataFrame, giocatori: DataFrame) -> DataFrame:
    """Rows to append to mia_rosa: accepted and mine, with the player's role."""
    g = giocatori.select(F.col("id").alias("_gid"), "ruolo")
    mine = judged.where(F.col("accepted") & F.col("e_mio"))
    return mine.join(g, mine.giocatore_id == g._gid).select(
        "id", "giocatore_id", F.col("prezzo_finale").alias("prezzo_pagato"),
        F.col("ruolo").alias("ruolo_fanta"), F.col("ts").alias("acquistato_il"))
