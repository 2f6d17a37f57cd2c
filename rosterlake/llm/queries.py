"""The registered queries ``op1`` to ``op13`` under their contracts, and their SQL.

Every query reads its whole table. ``ORACLE_SQL`` holds DuckDB SQL where SQL can
express the contract; the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, html_extract, jaccard_join, language_id, lexical_search, license_scan, line_dedup, periodic_runs, piece_bpe,
               quality_rules, substring_dedup, suffix_dedup)
from .common import table

# Where the public tokenizer files lie; the file goes from the driver to the tasks.
TOKENIZER_DIR = os.environ.get("ROSTERLAKE_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    try:
        import public_tokenizers
    except ImportError:     # the files without their package
        return os.path.join(TOKENIZER_DIR, name)
    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan.scan(docs).withColumnRenamed("file_id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_columns(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train(pages))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id")


def folded(docs: DataFrame) -> DataFrame:
    """The contract's words: with h = crc32(doc_id), g = h div 10, a tenth of the documents
    goes on from word a = g % n by repeating the p = 1 + (n - a) div (3 + g % 8) words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("crc32(cast(doc_id as string)) div 10")

    def fold(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " "))

    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(F.transform(F.array(words), fold), F.lit(0))).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect_runs(folded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_suffix_dedup, op3_bpe, op4_decontaminate, op5_jaccard_join, op6_license_scan, op7_quality_rules, op8_language_id, op9_line_dedup,
    op10_html_extract, op11_piece_bpe, op12_lexical_search, op13_periodic_runs)}

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP4 = rf"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
       SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
     b AS (SELECT item_id, w, len(w) AS n FROM (
       SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
     win AS (SELECT DISTINCT item_id, least(n, 10) AS m, array_to_string(w[k : k + least(n, 10) - 1], ' ') AS s
             FROM b, generate_series(1, greatest(n - 9, 1)) AS g(k) WHERE n > 0 AND k <= greatest(n - 9, 1)),
     lens AS (SELECT DISTINCT m FROM win),
     dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     starts AS (SELECT doc_id, m, unnest(generate_series(1, len(w) - m + 1)) AS k, w FROM dw, lens WHERE len(w) >= m),
     hits AS (SELECT s.doc_id, s.k, s.m, win.item_id FROM starts s JOIN win ON win.m = s.m AND win.s = array_to_string(s.w[s.k : s.k + s.m - 1], ' ')),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS p FROM hits) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _sql_marks(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


def _op7_sql() -> str:
    """The rules of ``quality_rules`` over lines and 3-word windows as tables."""
    q = quality_rules
    line_size = f"length(regexp_replace(line, '{_WS}', '', 'g'))"
    marks, seps, breaks = _sql_marks("line", q.LINE_MARKS), _sql_marks("line", q.NAV_SEPARATORS), _sql_marks("line", " \t")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
     lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
     lost AS (SELECT doc_id, sum({line_size}) AS lost FROM lines
              WHERE ({marks} >= {q.MIN_MARKS} AND {marks} > {line_size} * {q.MAX_MARK_SHARE})
                 OR ({seps} >= {q.MIN_NAV_SEPARATORS} AND {breaks} + 1 <= ({seps} + 1) * {q.MAX_NAV_WORDS_PER_ITEM + 1})
                 OR ({breaks} < {q.MAX_BOILERPLATE_WORDS} AND regexp_matches(line, '{q.BOILERPLATE}')) GROUP BY 1),
     win AS (SELECT doc_id, k, array_to_string(w[k : k + 2], ' ') AS s FROM (
             SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM t WHERE len(w) >= 3)),
     rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
     cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM rep) GROUP BY 1),
     base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
              CAST({_sql_marks("text", q.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost
              FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
         AND lost <= word_chars * {q.MAX_LOST_SHARE} AS kept
FROM base
"""


_OP9 = rf"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (
       SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
     k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), '{_UPPER}', '{_LOWER}') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {line_dedup.MIN_KEY_CHARS}
           GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
     m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
     win AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS s FROM (
             SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d WHERE len(w) >= 20)),
     late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(k, k + 19)) AS p FROM late)),
     words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
     kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
              FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP12_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_OP12_WORD}') AS w FROM documents),
     total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
     q AS (SELECT item_id, text, term, count(*) AS times FROM (
           SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_OP12_WORD}')) AS term
           FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
     tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
     weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (
                SELECT term, count(*) AS df FROM tf GROUP BY term), total),
     part AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS s FROM tf JOIN weight USING (term), total),
     hit AS (SELECT item_id, text, row, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY ALL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical_search.TOP}
"""

ORACLE_SQL = {"op1_substring_dedup": _OP1, "op4_decontaminate": _OP4, "op7_quality_rules": _op7_sql(), "op9_line_dedup": _OP9, "op12_lexical_search": _OP12}
