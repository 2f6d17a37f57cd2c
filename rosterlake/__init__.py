"""rosterlake: roster, auction and rating analytics as Spark jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` (lazy, no global
session). Typical use on stored tables::

    from rosterlake import LeagueTables, score
    t = LeagueTables.from_parquet(spark, "/data/league")
    score.expected_value(t.giocatori, t.statistiche_storiche, t.asta_log, ruolo="C").show()

The driver-table mapping used by the tests and the bench is
``rosterlake.sources.model.LeagueModel``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rosterlake.operators import (auction, documents, etl, league, market, merge, players,  # noqa: F401
                                  quality, score, search)

__version__ = "0.1.0"

TABLES = ("giocatori", "statistiche_storiche", "squadre", "asta_log", "mia_rosa", "voti_giornata")


@dataclass(frozen=True)
class LeagueTables:
    """The league tables as DataFrames (any source: parquet, a catalog, ...)."""

    giocatori: DataFrame
    statistiche_storiche: DataFrame
    squadre: DataFrame
    asta_log: DataFrame
    mia_rosa: DataFrame
    voti_giornata: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> LeagueTables:
        """Read ``{root}/{table}`` for every league table (lazy)."""
        root = root.rstrip("/")
        return cls(**{name: spark.read.parquet(f"{root}/{name}") for name in TABLES})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> LeagueTables:
        """Read ``{database}.{table}`` from the session catalog (lazy)."""
        return cls(**{name: spark.table(f"{database}.{name}") for name in TABLES})
