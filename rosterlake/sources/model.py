"""League tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables; the league model (players, season stats, teams,
auction log, my roster, round grades, purchase attempts, logs) is derived from them
by plain Spark jobs so that every query's work grows with the input. Every table
here is a lazy DataFrame: nothing is read until an action, and Catalyst prunes the
columns and pushes the filters down to each parquet scan.

Mapping (fixed, documented in README):
  giocatori            <- part
  statistiche_storiche <- lineitem grouped by (l_partkey, year(l_shipdate))
  squadre              <- customer + nation
  asta_log             <- lineitem: an order is an auction, its lines are the bids
  mia_rosa             <- first purchase per player of MY_TEAM in asta_log
  voti_giornata        <- lineitem grouped by (l_partkey, year, day of l_shipdate)
  purchase attempts    <- events of type 'purchase'; census from 'signup',
                          under the names of the teams of asta_log
  app_logs             <- events
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up
from rosterlake.plans.broadcast import NATION_ROWS, broadcast_bounded

# Fixed values of the model (not data):
MY_TEAM = "Customer#000000002"   # the user's own team in asta_log
MY_USER = 2                      # the same team among the events
TEAM_NAME = "Customer#%09d"      # a team's name from its number
TEAMS_PER_SUPPLIER = 15          # customers per supplier in the driver tables
AUCTION_BUDGET = 700.0           # budget of every team in the purchase census
LOG_APP_NAME = "chatbot"
RENUMBERED_SIZE = 40             # parts above this size are new players in the new price list
NEW_PLAYER = 1_000_000_000       # added to the part key of a new player
SHEET_DIR = "/sheets"    # nominal folder of the exported season sheets


def season_label(year: F.Column) -> F.Column:
    """``YYYY/YY`` for the season starting in ``year``."""
    return F.concat(year.cast("string"), F.lit("/"),
                    F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


class DriverTables:
    """Lazy access to ``{sf_dir}/{name}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class LeagueModel:
    """The league tables over one set of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = DriverTables(spark, sf_dir)
        self.spark = spark

    # -- players -----------------------------------------------------------
    @cached_property
    def giocatori(self) -> DataFrame:
        p = self.t.table("part")
        size = F.col("p_size")
        ruolo = (F.when(size <= 12, "P").when(size <= 25, "D")
                 .when(size <= 38, "C").otherwise("A"))
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("fanta_id"),
            F.col("p_name").alias("nome"),
            ruolo.alias("ruolo"),
            F.col("p_brand").alias("squadra"),
            size.cast("double").alias("quotazione_iniziale"),
            size.cast("double").alias("quotazione_attuale"),
            (size + 30).cast("double").alias("fvm"),
        )

    # -- season statistics -------------------------------------------------
    @cached_property
    def statistiche(self) -> DataFrame:
        li = self.t.table("lineitem")
        year = F.year("l_shipdate")
        q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")

        def cnt(cond):
            return F.count_if(cond).cast("int")

        # Partial aggregation before the shuffle: a hot part collapses map-side.
        agg = li.groupBy(F.col("l_partkey").alias("giocatore_id"), year.alias("anno")).agg(
            F.sum("l_linenumber").cast("int").alias("presenze"),
            F.count(F.lit(1)).cast("int").alias("gol"),
            cnt(flag == "R").alias("assist"),
            F.avg(F.round(disc * 100)).alias("_mv"),
            F.avg(q).alias("_fm"),
            cnt(status == "O").alias("gol_subiti"),
            cnt(q <= 2).alias("rigori_parati"),
            cnt(q >= 48).alias("rigori_calciati"),
            cnt(q >= 40).alias("bonus"),
            cnt(q <= 10).alias("malus"),
            cnt(q == 1).alias("autogol"),
            cnt(flag == "A").alias("ammonizioni"),
            cnt(tax >= 0.075).alias("espulsioni"),
        )
        return agg.select(
            (F.col("giocatore_id") * 10000 + F.col("anno")).alias("id"),
            "giocatore_id",
            season_label(F.col("anno")).alias("stagione"),
            "presenze", "gol", "assist",
            round_half_up(F.col("_mv"), 2).alias("media_voto"),
            round_half_up(F.col("_fm"), 2).alias("fantamedia"),
            "gol_subiti", "rigori_parati", "rigori_calciati", "bonus", "malus",
            "autogol", "ammonizioni", "espulsioni",
        )

    # -- league teams ------------------------------------------------------
    @cached_property
    def squadre(self) -> DataFrame:
        c = self.t.table("customer")
        # nation is the fixed 25-row dimension of the TPC-H schema: its size is
        # bounded by the spec, so broadcasting it is safe at any scale.
        n = broadcast_bounded(self.t.table("nation").select("n_nationkey", "n_name"), NATION_ROWS,
                              "TPC-H nation dimension")
        return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("nome"),
            F.col("n_name").alias("allenatore"),
            F.col("c_acctbal").alias("budget_totale"),
        )

    # -- auction log -------------------------------------------------------
    @cached_property
    def asta_log(self) -> DataFrame:
        """One sale per order: its highest bid wins (of equal ones the greatest part,
        supplier, line, date). Every third player is ever up for sale, the others stay free."""
        bid = F.struct("l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
        won = self.t.table("lineitem").groupBy("l_orderkey").agg(F.max(bid).alias("b"))
        return won.select(
            F.col("l_orderkey").alias("id"),
            (F.col("b.l_partkey") - F.col("b.l_partkey") % 3).alias("giocatore_id"),
            F.col("b.l_quantity").alias("prezzo_finale"),
            F.format_string(TEAM_NAME, F.col("b.l_suppkey") * TEAMS_PER_SUPPLIER + F.col("l_orderkey") % TEAMS_PER_SUPPLIER)
            .alias("squadra_acquirente"),
            F.lit("lineitem").alias("fonte"),
            F.col("b.l_shipdate").alias("creato_il"),
        )

    # -- my roster ---------------------------------------------------------
    @cached_property
    def mia_rosa(self) -> DataFrame:
        mine = self.asta_log.filter(F.col("squadra_acquirente") == MY_TEAM)
        # First purchase per player by (creato_il, id): min over a struct is an
        # aggregate with map-side partials, so a player bought many times never
        # lands in one task whole.
        first = mine.groupBy("giocatore_id").agg(
            F.min(F.struct("creato_il", "id", "prezzo_finale")).alias("f"))
        g = self.giocatori.select(F.col("id").alias("gid"), "ruolo")
        return first.join(g, first.giocatore_id == g.gid, "left").select(
            F.col("f.id").alias("id"),
            "giocatore_id",
            F.col("f.prezzo_finale").alias("prezzo_pagato"),
            F.col("ruolo").alias("ruolo_fanta"),
            F.col("f.creato_il").alias("acquistato_il"),
        )

    # -- round grades ------------------------------------------------------
    @cached_property
    def voti_giornata(self) -> DataFrame:
        li = self.t.table("lineitem")
        q = F.col("l_quantity")
        year = F.year("l_shipdate")
        # one row per (player, season, round): partial aggregation map-side
        agg = li.groupBy(F.col("l_partkey").alias("giocatore_id"), year.alias("anno"),
                         F.dayofmonth("l_shipdate").alias("giornata")).agg(
            (F.min(q) / 5).alias("voto"),
            ((F.max(q) - 1) / 5).alias("fantavoto"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("gol"),
            F.count_if(F.col("l_returnflag") == "A").cast("int").alias("assist"),
            F.bool_or(F.col("l_linestatus") == "O").alias("ammonizione"),
            F.bool_or(F.col("l_tax") >= 0.075).alias("espulsione"),
        )
        return agg.select(
            (F.col("giocatore_id") * 1000000 + F.col("anno") * 100 + F.col("giornata")).alias("id"),
            "giocatore_id", "giornata",
            season_label(F.col("anno")).alias("stagione"),
            "voto", "fantavoto", "gol", "assist", "ammonizione", "espulsione",
        )

    # -- purchase attempts and census (X9 / T1) ----------------------------
    @cached_property
    def purchase_attempts(self) -> DataFrame:
        e = self.t.table("events").filter(F.col("event_type") == "purchase")
        return e.select(
            F.col("ts"),
            F.col("event_id").alias("id"),
            F.get_json_object("props", "$.k").cast("long").alias("giocatore_id"),
            F.col("value").alias("prezzo_finale"),
            F.format_string(TEAM_NAME, "user_id").alias("squadra_acquirente"),
            (F.col("user_id") == MY_USER).alias("e_mio"),
            F.lit("events").alias("fonte"),
        )

    @cached_property
    def auction_census(self) -> DataFrame:
        e = self.t.table("events").filter(F.col("event_type") == "signup")
        return (e.select(F.format_string(TEAM_NAME, "user_id").alias("nome"))
                .distinct()
                .select("nome", F.lit(None).cast("string").alias("allenatore"),
                        F.lit(AUCTION_BUDGET).alias("budget_totale")))

    # -- fixtures and probable line-ups -------------------------------------
    @cached_property
    def calendario(self) -> DataFrame:
        """A team's first order of a day of the month in a season is its home match."""
        o = self.t.table("orders")
        first = o.groupBy(F.dayofmonth("o_orderdate").alias("giornata"), F.format_string(TEAM_NAME, "o_custkey").alias("squadra_casa"),
                          season_label(F.year("o_orderdate")).alias("stagione")).agg(
            F.min("o_orderkey").alias("id"), F.min("o_orderdate").alias("data_partita"))
        return first.select("id", "giornata", "squadra_casa", F.format_string(TEAM_NAME, F.col("id") % 1000).alias("squadra_trasferta"),
                            "data_partita", "stagione")

    @cached_property
    def formazioni_probabili(self) -> DataFrame:
        """A club's players by size class, as the starters of a round."""
        p = self.t.table("part")
        starter = F.struct("p_partkey", F.col("p_name").alias("v"))
        rows = p.groupBy((F.col("p_size") % 38 + 1).cast("int").alias("giornata"), F.col("p_brand").alias("squadra")).agg(
            F.min("p_partkey").alias("id"), F.sort_array(F.collect_list(starter)).alias("s"))
        return rows.select("id", "giornata", "squadra", F.lit("4-3-3").alias("modulo"), F.transform("s", lambda x: x["v"]).alias("titolari"),
                           F.lit("part").alias("fonte"), F.lit(None).cast("timestamp_ntz").alias("creato_il"))

    # -- application logs --------------------------------------------------
    @cached_property
    def request_logs(self) -> DataFrame:
        """The events as request log rows: method, path, status and time in ``extra``."""
        kind = F.col("event_type")
        request = F.struct(
            F.when(kind.isin("view", "click"), "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), kind).alias("path"),
            F.when(kind == "error", 503).otherwise(200).alias("status"), F.col("value").alias("ms"))
        return self.t.table("events").select(F.col("event_id").alias("id"), "ts", F.to_json(request).alias("extra"))

    @cached_property
    def app_logs(self) -> DataFrame:
        e = self.t.table("events")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("ts"),
            F.upper("event_type").alias("level"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"),
            F.col("props").alias("extra"),
            F.lit(LOG_APP_NAME).alias("app_name"),
        )

    # -- price list sheet and season sheets (ETL inputs) ---------------------
    @cached_property
    def previous_players(self) -> DataFrame:
        """The player table as loaded from the previous price list."""
        return self.giocatori

    @cached_property
    def price_sheet(self) -> DataFrame:
        """The new price list as exported sheet rows: every cell is text, names
        padded with blanks as exported sheets often are. Parts up to
        RENUMBERED_SIZE are the players of the previous list, the others are new."""
        p = self.t.table("part")
        size = F.col("p_size")
        number = F.col("p_partkey") + F.when(size > RENUMBERED_SIZE, F.lit(NEW_PLAYER)).otherwise(F.lit(0))
        ruolo = (F.when(size <= 12, "P").when(size <= 25, "D")
                 .when(size <= 38, "C").otherwise("A"))
        return p.select(
            number.cast("string").alias("Id"),
            ruolo.alias("R"),
            F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("Nome"),
            F.col("p_brand").alias("Squadra"),
            (size + 1).cast("string").alias("Qt.A"),
            size.cast("string").alias("Qt.I"),
            (size * 3).cast("string").alias("FVM"),
            F.col("p_partkey").alias("_ordinal"),
        )

    @cached_property
    def stats_sheets(self) -> DataFrame:
        """One season sheet per year as rows of text cells, with the sheet title
        and file path; even years carry the season in the title, odd years only
        in the file name. Some rows name an unknown player, some lack their
        appearances."""
        s = self.statistiche
        yr = F.substring("stagione", 1, 4)
        yy = F.substring("stagione", 6, 2)
        even = yr.cast("int") % 2 == 0
        title = F.when(even, F.concat(F.lit("Statistiche Fantacalcio Stagione "), yr, F.lit(" "), yy)) \
            .otherwise(F.lit("Statistiche Fantacalcio"))
        path = F.concat(F.lit(SHEET_DIR + "/Statistiche_"), yr, F.lit("_"), yy, F.lit(".csv"))
        t = lambda c: F.col(c).cast("string")
        number = F.col("giocatore_id") + F.when(F.col("presenze") % 10 == 9, F.lit(NEW_PLAYER)).otherwise(F.lit(0))
        return s.select(
            title.alias("_title"), path.alias("_path"),
            number.cast("string").alias("Id"), F.when(F.col("presenze") % 10 != 8, t("presenze")).alias("Pv"),
            t("media_voto").alias("Mv"), t("fantamedia").alias("Fm"), t("gol").alias("Gf"), t("gol_subiti").alias("Gs"),
            t("rigori_parati").alias("Rp"), t("rigori_calciati").alias("Rc"), t("bonus").alias("R+"),
            t("malus").alias("R-"), t("assist").alias("Ass"), t("ammonizioni").alias("Amm"),
            t("espulsioni").alias("Esp"), t("autogol").alias("Au"),
        )
