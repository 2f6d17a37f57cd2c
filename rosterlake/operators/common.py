"""Building blocks shared by the query operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("P", "D", "C", "A")  # fixed values: goalkeeper, defender, midfielder, forward


def taken_players(asta_log: DataFrame) -> DataFrame:
    """Distinct non-NULL player ids in the auction log.

    The distinct is a partial (map-side) aggregate, so a player bought a million
    times becomes one row per partition before the shuffle; its output is already
    hash-partitioned on ``giocatore_id`` and the anti-join that follows reuses it.
    NULL ids are left out (a NULL in ``NOT IN`` would otherwise empty the answer).
    """
    return (asta_log.select(F.col("giocatore_id").alias("_taken_id"))
            .where(F.col("_taken_id").isNotNull()).distinct())


def free_players(giocatori: DataFrame, asta_log: DataFrame, id_col: str = "id") -> DataFrame:
    """Players never sold: ``left_anti`` (sort-merge or broadcast, AQE decides)."""
    taken = taken_players(asta_log)
    return giocatori.join(taken, giocatori[id_col] == taken["_taken_id"], "left_anti")


def capped_limit(limit, default: int = 10, cap: int = 50) -> int:
    """``min(int(limit or default), cap)``: 0 and NULL give the default."""
    return min(int(limit or default), cap)


def like_pattern(text: str, escape: bool = False) -> str:
    """``%text%``. By default the user's ``%`` and ``_`` act as wildcards, as in
    the source app; ``escape=True`` matches them literally."""
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{text}%"


def any_of(conds: list[Column]) -> Column:
    return reduce(or_, conds)


def ordered(col: str, ascending: bool) -> Column:
    return F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
