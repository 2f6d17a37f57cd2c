"""Substring search of many words at once over a table of character runs.

The posting table has a row (key, id) for every distinct run of one to three
characters of a lower-case name. A word is looked up by the rarest of its keys (two at
most): the players that hold all of them are the candidates, and only they are
compared with the word by ``ilike``, so ``%`` and ``_`` in a word are wildcards as in
the one-word searches. A search is a few equi-joins on ``key`` and ``id``: it reads the
postings of the chosen keys, not the names.

Spark takes the postings, exploded from the names, for no larger than the names, and
would send them whole through the driver to every executor: the joins ask for sorted
merges instead, with the postings as the side that streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.common import free_players

LONGEST = 3      # characters of the longest key
PROBES = 2       # keys that a word is looked up by


def _runs(text: Column, n: int) -> Column:
    """The runs of ``n`` characters of ``text``."""
    last = F.char_length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def name_index(giocatori: DataFrame, id_col: str = "id", name_col: str = "nome") -> DataFrame:
    """Posting table (key, id); partition or bucket it by ``key`` where it is stored."""
    name = F.lower(F.col(name_col))
    keys = F.array_distinct(F.concat(*[_runs(name, n) for n in range(1, LONGEST + 1)]))
    return giocatori.where(F.col(name_col).isNotNull()).select(F.explode(keys).alias("key"), F.col(id_col).alias("id"))


def _keys_of(word: Column) -> Column:
    """Keys that every match of ``word`` holds: the longest runs of each literal part."""
    parts = F.split(F.lower(word), "[%_]")
    per = F.transform(parts, lambda p: F.when(F.char_length(p) >= LONGEST, _runs(p, LONGEST))
                      .when(F.char_length(p) > 0, F.array(p)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(per))


def find_names(index: DataFrame, giocatori: DataFrame, words: DataFrame, id_col: str = "id", name_col: str = "nome") -> DataFrame:
    """(word, the player's columns) for every distinct ``words.word`` and every player whose
    name it matches. A word without a literal character would match every name: it
    fails the query. NULL words match nothing."""
    w = words.select("word").where("word is not null").distinct()
    keys = _keys_of(F.col("word"))
    checked = F.when(F.size(keys) > 0, keys).otherwise(F.raise_error(F.concat(F.lit("no literal character in: "), F.col("word"))))
    wanted = w.select("word", F.explode(checked).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("_df"))
    rarest = Window.partitionBy("word").orderBy(F.coalesce(F.col("_df"), F.lit(0)), "key")
    probes = (wanted.join(sizes.hint("shuffle_merge"), "key", "left")
              .withColumn("_rank", F.row_number().over(rarest)).where(F.col("_rank") <= PROBES))
    asked = probes.withColumn("_asked", F.max("_rank").over(Window.partitionBy("word"))).select("word", "key", "_asked")
    hits = (index.withColumnRenamed("id", "_id").join(asked.hint("shuffle_merge"), "key").groupBy("word", "_id")
            .agg(F.count_distinct("key").alias("_met"), F.max("_asked").alias("_asked")).where("_met = _asked"))
    found = hits.select("word", "_id").join(giocatori.hint("shuffle_merge"), F.col("_id") == F.col(id_col))
    return found.where(F.expr(f"`{name_col}` ILIKE concat('%', word, '%')")).select("word", *giocatori.columns)


def live_searches(index: DataFrame, giocatori: DataFrame, asta_log: DataFrame, words: DataFrame,
                  limit: int = 10, solo_liberi: bool = True) -> DataFrame:
    """X11b for many words at once: each word's first ``limit`` (free) players by fvm, id."""
    players = free_players(giocatori, asta_log) if solo_liberi else giocatori
    found = find_names(index, players, words).select("word", "id", "nome", "ruolo", "squadra", "quotazione_attuale", "fvm")
    best = Window.partitionBy("word").orderBy(F.col("fvm").desc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
