"""Quality rules, line first, in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing
lines are removed and a document that loses too much of its text that way is
rejected. Document-level base statistics come with it. One projection over the
rows: no shuffle, no Python.

Defined results: null or blank text has no words and fails the base rule. A line
of white space only never fails. Extra columns pass through (working columns carry
the prefix ``_q_``); one with the name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

# Fixed values (contract): the symbol characters and the base limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Line rules: parameters of this method.
LINE_MARKS = "#*$%&|<>!?{}[]~^_=+\\@"   # marks that prose uses rarely
MAX_MARK_SHARE = 0.10                    # of a line's characters
MIN_MARKS = 4                            # below this a line is never marked down for punctuation
NAV_SEPARATORS = "|»›•·→"
MIN_NAV_SEPARATORS = 3
MAX_NAV_WORDS_PER_ITEM = 4
BOILERPLATE = (r"(?i)\b(all rights reserved|cookie (policy|settings|notice)|privacy policy|"
               r"terms of (use|service)|enable javascript|click here to|subscribe to our newsletter|"
               r"skip to (main )?content|back to top|share (this )?on (facebook|twitter))\b")
MAX_BOILERPLATE_WORDS = 40
MAX_LOST_SHARE = 0.30                    # of a document's non-white characters

_WORD_BREAK = r"[\x20\x09-\x0D]+"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def line_fails(line: Column) -> Column:
    """True for a line that breaks the punctuation, navigation or boilerplate rule."""
    size = F.length(_without(line, WHITE))
    marks = F.length(line) - F.length(_without(line, LINE_MARKS))
    breaks = F.length(line) - F.length(_without(line, " \t"))
    seps = F.length(line) - F.length(_without(line, NAV_SEPARATORS))
    punctuation = (marks >= MIN_MARKS) & (marks > size * MAX_MARK_SHARE)
    navigation = (seps >= MIN_NAV_SEPARATORS) & (breaks + 1 <= (seps + 1) * (MAX_NAV_WORDS_PER_ITEM + 1))
    boilerplate = (breaks < MAX_BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def quality_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and clean_text (the text without its failing lines)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    i64 = lambda c: c.cast("long")
    df = docs.withColumn("_q_strip", _stripped(raw))
    df = df.withColumn(
        "_q_words", F.when(F.col("_q_strip") == "", F.array().cast("array<string>"))
        .otherwise(F.split("_q_strip", _WORD_BREAK)))
    df = df.withColumn("_q_lines", F.split(raw, "\n"))
    # 3-word windows by (hash, place), sorted: equal windows become neighbours
    df = df.withColumn(
        "_q_windows", F.when(F.size("_q_words") < 3, F.expr("array()").cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.expr("sort_array(transform(sequence(0, size(_q_words) - 3), i -> named_struct("
                          "'h', xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2]), 'i', i)))")))
    df = df.withColumn("_q_starts", F.expr(
        "sort_array(transform(filter(_q_windows, (x, k) -> (k > 0 and _q_windows[k - 1].h = x.h) or "
        "(k < size(_q_windows) - 1 and _q_windows[k + 1].h = x.h)), x -> x.i))"))
    df = df.withColumn("_q_wordy", F.filter("_q_lines", lambda x: _stripped(x) != ""))
    df = df.withColumn("_q_good", F.filter("_q_lines", lambda x: ~line_fails(x)))
    df = df.withColumn("clean_text", F.when(F.col(text).isNotNull(), F.array_join("_q_good", "\n")))
    df = df.withColumns({
        "n_words": i64(F.size("_q_words")),
        "word_chars": i64(F.length(_without(raw, WHITE))),
        "n_symbols": i64(F.length(raw) - F.length(_without(raw, SYMBOLS))),
        "n_dup_lines": i64(F.size("_q_wordy") - F.size(F.array_distinct("_q_wordy"))),
        "n_repeat_words": i64(F.expr(
            "aggregate(_q_starts, named_struct('n', 0, 'e', 0), "
            "(a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.e), 'e', i + 3), a -> a.n)")),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    left = F.length(_without(F.coalesce("clean_text", F.lit("")), WHITE))
    lost = F.col("word_chars") - left
    # a caller's filter on ``kept`` must not be pushed below, into a copy of all of
    # the above for every use; the optimizer leaves a non-deterministic term in place
    fence = F.monotonically_increasing_id() >= 0
    df = df.withColumn("kept", fence & ~F.col("base_failed") & (lost <= F.col("word_chars") * MAX_LOST_SHARE))
    return df.drop("_q_strip", "_q_words", "_q_lines", "_q_windows", "_q_starts", "_q_wordy", "_q_good")
