"""Stored model answers -> typed rows (S7) -> one row per extracted item.

An image-extraction model answers with JSON text of one of three shapes. The
answers are a text column; each is parsed once into a VARIANT (``try_parse_json``)
and read by path with ``try_variant_get``, so that a cell of another type is NULL
and doesn't spoil its row. Text that is no JSON stays in ``errore`` and has no items;
JSON of another shape has none either (``n_items`` NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three answer shapes: the list of items, and an item's fields.
ITEMS = {"listone": "giocatori", "formazione": "titolari", "asta": "acquisti"}
FIELDS = {
    "listone": {"nome": "string", "ruolo": "string", "squadra": "string", "quotazione": "double"},
    "formazione": {"titolare": "string"},
    "asta": {"nome": "string", "prezzo_finale": "double", "squadra_acquirente": "string"},
}
FORMATION_KIND = "formazione"


def _items(kind: str, answer: str = "_answer") -> Column:
    return F.try_variant_get(answer, f"$.{ITEMS[kind]}", "array<variant>")


def parse_answers(answers: DataFrame, kind: str | None = None, raw_col: str = "raw_response", kind_col: str = "kind") -> DataFrame:
    """Add ``is_json``, ``errore`` (the text, where it is no JSON), ``modulo`` (of a
    formation), ``items`` (array of VARIANT) and ``n_items``. ``kind`` is the shape of all
    answers, or each row has its own in ``kind_col``."""
    a = answers.withColumn("_answer", F.try_parse_json(raw_col))
    ok = F.col("_answer").isNotNull()
    if kind is None:
        items, is_formation = None, F.col(kind_col) == FORMATION_KIND
        for k in ITEMS:
            items = F.when(F.col(kind_col) == k, _items(k)) if items is None else items.when(F.col(kind_col) == k, _items(k))
    else:
        items, is_formation = _items(kind), F.lit(kind == FORMATION_KIND)
    out = a.withColumns({
        "is_json": ok,
        "errore": F.when(~ok, F.col(raw_col)),
        "modulo": F.when(is_formation, F.try_variant_get("_answer", "$.modulo", "string")),
        "items": items,
    })
    return out.withColumn("n_items", F.size("items")).withColumn("n_items", F.when(F.col("n_items") >= 0, F.col("n_items"))).drop("_answer")


def flatten_answers(parsed: DataFrame, kind: str, id_col: str = "answer_id") -> DataFrame:
    """One row per extracted item of answers of one kind, position kept; answers without
    items give one row of NULLs (``posexplode_outer``)."""
    rows = parsed.select(id_col, F.posexplode_outer("items").alias("pos", "item"))
    field = lambda name, t: F.try_variant_get("item", "$" if kind == FORMATION_KIND else f"$.{name}", t).alias(name)
    return rows.select(id_col, "pos", *[field(name, t) for name, t in FIELDS[kind].items()])


def flatten_all(parsed: DataFrame, id_col: str = "answer_id", kind_col: str = "kind") -> DataFrame:
    """The items of all answers by their own kind, in one pass: ``valore`` is the price of
    a purchase or the quotation of a listed player; a starter is a ``nome``."""
    rows = parsed.select(id_col, kind_col, F.posexplode_outer("items").alias("pos", "item"))
    get = lambda path, t: F.try_variant_get("item", path, t)
    starter = F.col(kind_col) == FORMATION_KIND
    return rows.select(
        id_col, kind_col, "pos",
        F.when(starter, get("$", "string")).otherwise(get("$.nome", "string")).alias("nome"),
        get("$.ruolo", "string").alias("ruolo"), get("$.squadra", "string").alias("squadra"),
        F.when(F.col(kind_col) == "asta", get("$.prezzo_finale", "double")).otherwise(get("$.quotazione", "double")).alias("valore"),
        get("$.squadra_acquirente", "string").alias("squadra_acquirente"))


def answers_from_tables(asta_log: DataFrame, giocatori: DataFrame, conversations: DataFrame, events: DataFrame) -> DataFrame:
    """Answer texts from the driver tables: one auction-board answer per team, one
    price-list answer and one formation per club, the assistant turns of the
    conversations (which are no JSON) and the events' properties (JSON of another shape).
    Columns: answer_id, kind, raw_response."""
    g = giocatori.select(F.col("id").alias("_gid"), "nome", "ruolo", "squadra", "quotazione_attuale")
    ordered = lambda *cols: F.transform(F.sort_array(F.collect_list(F.struct(*cols))), lambda x: x["v"])
    sale = F.struct("nome", "prezzo_finale", "squadra_acquirente")
    board = (asta_log.join(g, asta_log.giocatore_id == g._gid).groupBy("squadra_acquirente")
             .agg(ordered("id", sale.alias("v")).alias("acquisti"))
             .select(F.concat(F.lit("asta-"), "squadra_acquirente").alias("answer_id"), F.lit("asta").alias("kind"),
                     F.to_json(F.struct("acquisti")).alias("raw_response")))
    player = F.struct("nome", "ruolo", "squadra", F.col("quotazione_attuale").alias("quotazione"))
    club = g.groupBy("squadra").agg(
        ordered("_gid", player.alias("v")).alias("giocatori"),
        ordered("_gid", F.col("nome").alias("v")).alias("titolari"))
    listing = club.select(F.concat(F.lit("listone-"), "squadra").alias("answer_id"), F.lit("listone").alias("kind"),
                          F.to_json(F.struct("giocatori")).alias("raw_response"))
    formation = club.select(F.concat(F.lit("formazione-"), "squadra").alias("answer_id"), F.lit(FORMATION_KIND).alias("kind"),
                            F.to_json(F.struct(F.lit("4-3-3").alias("modulo"), "titolari")).alias("raw_response"))
    chat = conversations.where(F.col("role") == "assistant").select(
        F.concat_ws("-", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        F.lit("asta").alias("kind"), F.col("text").alias("raw_response"))
    other = events.select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("answer_id"), F.lit("listone").alias("kind"),
                          F.col("props").alias("raw_response"))
    return board.unionByName(listing).unionByName(formation).unionByName(chat).unionByName(other)


def parse_all(answers: DataFrame) -> DataFrame:
    """Every answer by its own kind: answer_id, kind, is_json, modulo, n_items, errore."""
    return parse_answers(answers).select("answer_id", "kind", "is_json", "modulo", "n_items", "errore")
