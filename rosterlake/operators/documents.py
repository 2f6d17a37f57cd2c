"""Player documents, nearest vectors, context lines and recent messages
(X12, X12b, X13, X21, X22).

Text is built with JVM string functions (``concat``, ``format_string``,
``array_join``), never with Python per row. The nearest-vector search itself (X13) is
``rosterlake.operators.vectors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up
from rosterlake.operators.vectors import DEFAULT_TOP_K, nearest_vectors  # noqa: F401  (part of this module's interface)

# The text of documents and of the chat context, here and in the functions below.
NONE_TEXT = "None"  # how a missing value prints inside a document
RECENT_MESSAGES = 20
MAX_LOG_ROWS, DEFAULT_LOG_ROWS = 500, 100


def _txt(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(NONE_TEXT))


def player_documents(giocatori: DataFrame, stats: DataFrame, mia_rosa: DataFrame) -> DataFrame:
    """One descriptive text per player (X12): header, FVM if known, one sentence
    per season (newest first), and the price if the player is in my roster."""
    season_txt = F.concat(
        F.lit("Stagione "), _txt("stagione"), F.lit(": "), _txt("presenze"), F.lit(" presenze, "),
        _txt("gol"), F.lit(" gol, "), _txt("assist"), F.lit(" assist, media voto "),
        _txt("media_voto"), F.lit(", fantamedia "), _txt("fantamedia"), F.lit(". "))
    per = (stats.where(F.col("stagione").isNotNull())
           .groupBy(F.col("giocatore_id").alias("_sid"))
           .agg(F.sort_array(F.collect_list(F.struct("stagione", season_txt.alias("t"))), False).alias("_s")))
    mr = mia_rosa.select(F.col("giocatore_id").alias("_mid"), "prezzo_pagato")
    j = (giocatori.join(per, giocatori.id == per._sid, "left")
         .join(mr, giocatori.id == mr._mid, "left"))
    doc = F.concat(
        _txt("nome"), F.lit(" ("), _txt("ruolo"), F.lit(", "), _txt("squadra"), F.lit("). "),
        F.lit("Quotazione attuale: "), _txt("quotazione_attuale"), F.lit(". "),
        F.when(F.col("fvm").isNotNull(),
               F.concat(F.lit("Fantavalore di mercato (FVM): "), F.col("fvm").cast("string"), F.lit(". ")))
        .otherwise(F.lit("")),
        F.coalesce(F.array_join(F.transform("_s", lambda s: s["t"]), ""), F.lit("")),
        F.when(F.col("prezzo_pagato").isNotNull(),
               F.concat(F.lit("E' nella MIA ROSA, pagato "), F.col("prezzo_pagato").cast("string"),
                        F.lit(" crediti.")))
        .otherwise(F.lit("")),
    )
    return j.select(F.col("id").cast("string").alias("id"), doc.alias("document"),
                    F.col("id").alias("giocatore_id"))


def short_documents(giocatori: DataFrame) -> DataFrame:
    """``Nome: … | Ruolo: … | …`` with NULL parts left out."""
    parts = [F.concat(F.lit(label), F.col(c).cast("string")) for label, c in (
        ("Nome: ", "nome"), ("Ruolo: ", "ruolo"), ("Squadra: ", "squadra"),
        ("Quotazione: ", "quotazione_attuale"), ("FVM: ", "fvm"))]
    return giocatori.select("id", F.concat_ws(" | ", *parts).alias("testo_embedding"))


def upsert_documents(current: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Document upsert by id (I5): fresh rows replace, others are kept. Of fresh
    rows with one id the greatest by their other columns is taken."""
    rest = [c for c in fresh.columns if c != key]
    once = fresh.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    kept = current.join(once.select(key), key, "left_anti")
    return kept.unionByName(once)


# ----------------------------------------------------------------------------- X13
def label_centroids(embeddings: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                    id_col: str = "vec_id") -> DataFrame:
    """Mean vector per label: a query set derived from the corpus itself."""
    x = embeddings.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    per_dim = x.groupBy(label_col, "pos").agg(F.avg("x").alias("m"))
    return (per_dim.groupBy(F.col(label_col).alias("query_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
                 .alias("query_vector")))


# ----------------------------------------------------------------------------- X21
def player_lines(found: DataFrame) -> DataFrame:
    return found.select(F.concat(
        _txt("nome"), F.lit(" ("), _txt("ruolo"), F.lit(", "), _txt("squadra"), F.lit("): quot. "),
        _txt("quotazione_attuale"), F.lit(", FVM "), _txt("fvm")).alias("line"))


def budget_lines(budget: DataFrame) -> DataFrame:
    return budget.select(F.concat(F.lit("Mio budget: "), _txt("budget_residuo"), F.lit(" residui su "),
                                  _txt("budget_totale")).alias("line"))


def roster_lines(roster: DataFrame, price_col: str = "prezzo_pagato") -> DataFrame:
    return roster.select(F.concat(
        _txt("nome"), F.lit(" ("), _txt("ruolo"), F.lit(", "), _txt("squadra"), F.lit("), pagato "),
        _txt(price_col)).alias("line"))


def team_header_line(team_rows: DataFrame) -> DataFrame:
    """Header naming the team of the first row (by ruolo, nome, buyer, price)."""
    first = team_rows.agg(F.min(F.struct("ruolo", "nome", "nome_squadra", "prezzo_finale", "allenatore"))
                          .alias("f")).where(F.col("f").isNotNull())
    return first.select(F.concat(F.lit("Squadra trovata: '"), _txt("f.nome_squadra"),
                                 F.lit("' (allenatore: "), _txt("f.allenatore"), F.lit(")")).alias("line"))


def season_lines(seasons: DataFrame) -> DataFrame:
    return seasons.select(F.concat(
        _txt("nome"), F.lit(" ("), _txt("ruolo"), F.lit(", "), _txt("squadra"), F.lit(") stagione "),
        _txt("stagione"), F.lit(": fantamedia "), _txt("fantamedia"), F.lit(", gol "), _txt("gol"),
        F.lit(", assist "), _txt("assist"), F.lit(", presenze "), _txt("presenze")).alias("line"))


def with_empty_line(lines: DataFrame, text: str) -> DataFrame:
    """The lines, or one ``text`` line when there are none (``Nessun…``)."""
    spark = lines.sparkSession
    fallback = spark.createDataFrame([(text,)], "line string")
    n_lines = lines.agg(F.count(F.lit(1))).scalar()  # scalar subquery, not a join
    return lines.unionByName(fallback.where(n_lines == 0))


# ----------------------------------------------------------------------------- X22 / T2b / T2c
def recent_messages(conversations: DataFrame, n: int = RECENT_MESSAGES, conv_id=None) -> DataFrame:
    """The last ``n`` messages of one or every conversation (X22), each conversation's
    oldest first: sorted where they are, as a conversation is in one partition."""
    c = conversations if conv_id is None else conversations.where(F.col("conv_id") == conv_id)
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
            .sortWithinPartitions("conv_id", "turn"))


def recent_logs(app_logs: DataFrame, n: int | None = DEFAULT_LOG_ROWS) -> DataFrame:
    """The newest ``min(n, 500)`` log rows, returned oldest first."""
    n = min(int(n or DEFAULT_LOG_ROWS), MAX_LOG_ROWS)
    newest = app_logs.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
    return newest.orderBy("ts", "id").select("ts", "level", "message", "extra", "app_name")


def log_summary(app_logs: DataFrame) -> DataFrame:
    """Parse the JSON ``extra`` column and summarise per level."""
    parsed = app_logs.select("level", F.from_json("extra", "k long").alias("x"))
    return parsed.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("x.k").alias("n_with_k"),
        round_half_up(F.avg("x.k"), 2).alias("avg_k"),
        F.max("x.k").alias("max_k"))


REQUEST_SCHEMA = "method string, path string, status int, ms double"


def request_summary(app_logs: DataFrame) -> DataFrame:
    """Request log rows (``extra`` = {method, path, status, ms}) -> count,
    errors and latency per path (T2c); approximate percentiles are partial
    aggregates, so a hot path never lands whole in one task."""
    r = app_logs.select(F.from_json("extra", REQUEST_SCHEMA).alias("r")).select("r.*")
    return r.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("richieste"),
        F.count_if(F.col("status") >= 500).alias("errori"),
        round_half_up(F.avg("ms"), 1).alias("ms_medio"),
        F.percentile_approx("ms", 0.95).alias("ms_p95"))
