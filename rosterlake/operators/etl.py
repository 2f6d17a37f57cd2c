"""ETL transforms of the price list and of the season statistics.

Both transforms are column expressions over the scanned sheet rows (strings),
so they run where the rows are; the fanta_id -> id lookup is a join, never a
dictionary collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.numeric import safe_double, safe_int

# Required columns of the two sheets, and the FVM reference budget.
PRICE_LIST_REQUIRED = ("Id", "R", "Nome", "Squadra", "Qt.A", "Qt.I", "FVM")
STATS_REQUIRED = ("Id", "Pv", "Mv", "Fm", "Gf", "Gs", "Rp", "Rc", "R+", "R-", "Ass", "Amm", "Esp", "Au")
FVM_REFERENCE_BUDGET = 1000
# sheet column -> table column; int columns default to 0, float columns to NULL
STATS_INT_COLUMNS = (("Pv", "presenze"), ("Gf", "gol"), ("Gs", "gol_subiti"), ("Rp", "rigori_parati"),
                     ("Rc", "rigori_calciati"), ("R+", "bonus"), ("R-", "malus"), ("Ass", "assist"),
                     ("Amm", "ammonizioni"), ("Esp", "espulsioni"), ("Au", "autogol"))
STATS_FLOAT_COLUMNS = (("Mv", "media_voto"), ("Fm", "fantamedia"))
TITLE_SEASON = r"(\d{4})\D+(\d{2,4})"
FILE_SEASON = r"(\d{4})[_\-\s](\d{2,4})"

STATUS_OK = "importato"
STATUS_SKIPPED = "saltato"        # fanta_id not in the player table
STATUS_INCOMPLETE = "incompleto"  # NULL Id or Pv


def c(name: str) -> Column:
    """A sheet column by its header text (headers contain dots and signs)."""
    return F.col(f"`{name}`")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def season_from(title: Column, path: Column) -> Column:
    """``YYYY/YY`` from the sheet title, else from the file name, else NULL."""
    def pick(text: Column, pattern: str) -> Column:
        y1 = F.regexp_extract(text, pattern, 1)
        y2 = F.regexp_extract(text, pattern, 2)
        return F.when(y1 != "", F.concat(y1, F.lit("/"), F.substring(y2, -2, 2)))
    return F.coalesce(pick(F.coalesce(title, F.lit("")), TITLE_SEASON),
                      pick(basename(F.coalesce(path, F.lit(""))), FILE_SEASON))


_PRICE_NUMBERS = ("Id", "Qt.I", "Qt.A", "FVM")


def _named(raw: DataFrame) -> Column:
    return c("Nome").isNotNull() & c("Squadra").isNotNull()


def _unreadable() -> Column:
    """A number cell that holds text which is no number."""
    bad = F.lit(False)
    for name in _PRICE_NUMBERS:
        bad = bad | (c(name).isNotNull() & c(name).try_cast("double").isNull())
    return bad


def price_list_rejects(raw: DataFrame) -> DataFrame:
    """Named rows that can't be imported, as they are: a number cell holds other text."""
    return raw.where(_named(raw) & _unreadable())


def price_list_transform(raw: DataFrame, budget_lega: int = FVM_REFERENCE_BUDGET,
                         extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Sheet rows -> giocatori rows (X23): rows without Nome or Squadra are
    skipped; names trimmed; prices as double; fvm = ceil(FVM x budget / 1000). Rows
    with an unreadable number are left to ``price_list_rejects``."""
    scale = budget_lega / FVM_REFERENCE_BUDGET
    kept = raw.where(_named(raw) & ~_unreadable())
    return kept.select(
        c("Id").try_cast("double").try_cast("long").alias("fanta_id"),
        F.trim(c("Nome")).alias("nome"),
        F.trim(c("R")).alias("ruolo"),
        F.trim(c("Squadra")).alias("squadra"),
        c("Qt.I").try_cast("double").alias("quotazione_iniziale"),
        c("Qt.A").try_cast("double").alias("quotazione_attuale"),
        F.ceil(c("FVM").try_cast("double") * F.lit(scale)).cast("double").alias("fvm"),
        *extra_cols,
    )


def season_stats_transform(raw: DataFrame, giocatori: DataFrame, season: Column | str,
                           extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Sheet rows -> statistiche rows with a status per row.

    ``season`` is a column (per-file season from ``season_from``) or a fixed
    override. Rows with a NULL Id or Pv are ``incompleto``; an Id without player
    is ``saltato``; the others carry the parsed measures.
    """
    season_col = F.lit(season) if isinstance(season, str) else season
    g = giocatori.where(F.col("fanta_id").isNotNull()).select(
        F.col("fanta_id").alias("_fid"), F.col("id").alias("giocatore_id"))
    fid = c("Id").try_cast("double").try_cast("long")
    r = raw.select("*", fid.alias("_fanta_id"), season_col.alias("stagione"))
    j = r.join(g, r._fanta_id == g._fid, "left")
    complete = c("Id").isNotNull() & c("Pv").isNotNull()
    status = (F.when(~complete, F.lit(STATUS_INCOMPLETE))
              .when(F.col("giocatore_id").isNull(), F.lit(STATUS_SKIPPED))
              .otherwise(F.lit(STATUS_OK)))
    cols = [F.col("_fanta_id").alias("fanta_id"), "giocatore_id", "stagione"]
    cols += [safe_int(c(src)).alias(dst) for src, dst in STATS_INT_COLUMNS]
    cols += [safe_double(c(src)).alias(dst) for src, dst in STATS_FLOAT_COLUMNS]
    return j.select(*cols, status.alias("esito"), *extra_cols)


def season_column(paths, override: str | None = None) -> Column:
    """The season of every row (S4): an override applies only when exactly one
    file is imported (with several files each file's own title or name decides)."""
    n = 1 if isinstance(paths, str) else len(list(paths))
    if override and n == 1:
        return F.lit(override)
    return season_from(F.col("_title"), F.col("_path"))
