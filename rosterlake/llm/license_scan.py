"""Licence scans with DataFrame functions only.

A file's words, and those of its parts (runs of paragraphs in the words of licences,
paragraphs, lines, sentences), are sparse TF-IDF vectors; their cosine to the vectors
of several templates a licence (``license_texts``) names the licence. The largest
part that reaches ``MIN_COSINE`` counts, so a wrapped header or a whole text goes
before the lines in it; copyright lines are no part of a notice. Only templates that
share one of the rarest words of both (the prefixes without which ``MIN_COSINE``
can't be reached) are compared.

A file is a licence file if it is a licence as a whole, if half of its words are
notice lines, or if it is named as one and has a notice. A file without a notice of
its own inherits from the nearest directory above it that holds a licence file, by a
join of its ancestor directories. Term frequencies count as 1 + ln(tf); document
frequencies are counted over the licences, so no file's verdict depends on other
files' words.

Defined results: null or empty text has no notice; a null path is the root
directory; ties go to the template first by name; without any match the licence
is null. No Python runs on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import license_texts

# What every notice speaks of, whichever way it is worded (in lower case).
NOTICE = ("licen", "spdx", "redistribut", "permission", "copyleft", "creativecommons", "creative commons", "public domain", "neighboring rights",
          "cc by", "cc-by", "cc0", "gpl", "gfdl", "cddl", " mpl", "\nmpl", " epl", "\nepl")
MIN_COSINE = 0.7
PREFIX_COSINE = 0.699          # below MIN_COSINE by more than rounding
MIN_FILE_SHARE = 0.5           # of a file's words in notice lines: then it is a licence file
MIN_KNOWN_SHARE = 0.75         # of a paragraph's words in the templates' vocabulary: then it may belong to a text in several paragraphs
WHOLE, REGION, PARAGRAPH, LINE, SENTENCE = range(5)
COPYRIGHT = r"(?imd)^[^a-z0-9\n]*(copyright\s*(\(c\)|\u00a9|[0-9]{4}|\[|<|\{)|\(c\)\s|\u00a9)[^\n]*$"
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]es?|copying|[a-z0-9.]+-licen[cs]e)([._-][^/]*)?$"
CODE_NAME = r"(?i)\.(py|js|ts|java|c|cc|cpp|h|hpp|go|rs|rb|php|cs|sh|json|xml|css)$"


# Words that any notice may have, whatever its licence: they weigh least.
FILLER = frozenset("""a all an and any are article as at available be book by can code content copyright data details distributed document file files for found
free freely from here image images in is it its library license licensed may module of on or our package page program project project's published released
reserved rights see site software source terms text that the these this to under use was we which with work works you""".split())

# One spelling of the same thing: licence, GPLv3 and v3, 4.0 and 4.
_SPELLING = ((r"licenc", "licens"), (r"gpl[ -]?v?(?=[0-9])", "gpl "), (r"\bv(?=[0-9])", ""), (r"\b([0-9]+)\.0\b(?!\.[0-9])", "$1"))
_BREAK = r"[^a-z0-9.]+|\.(?=\s|$|[^a-z0-9.])"


def _words(text: Column) -> Column:
    text = F.lower(text)
    for pattern, to in _SPELLING:
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(text, _BREAK), lambda w: w != "")


def speaks(text: Column) -> Column:
    """Whether a text has a word of ``NOTICE``; it is put into lower case once."""
    def any_of(t: Column) -> Column:
        found = t.contains(NOTICE[0])
        for word in NOTICE[1:]:
            found = found | t.contains(word)
        return found
    return F.exists(F.array(F.lower(F.concat(F.lit(" "), text))), any_of)


def template_words(text: str) -> list[str]:
    """``_words`` on the driver."""
    text = text.lower()
    for pattern, to in _SPELLING:
        text = re.sub(pattern, to.replace("$", "\\"), text)
    return [w for w in re.split(_BREAK, text) if w]


@cache
def weights() -> tuple[dict[str, float], float, list[tuple[str, str, str, float, bool]]]:
    """(idf by word, idf of any other word, (template, licence, word, unit weight, in the prefix) of every template).
    A word's document frequency is the number of licences that have it. The prefix are the first words by idf without which
    the rest is shorter than ``PREFIX_COSINE``."""
    bags = [(name, Counter(template_words(text))) for name, text in license_texts.templates()]
    holders: dict[str, set[str]] = {}
    for name, bag in bags:
        for w in bag:
            holders.setdefault(w, set()).add(name)
    n = len({name for name, _ in bags})
    idf = {w: 1.0 for w in FILLER} | {w: 1 + math.log((1 + n) / (1 + len(names))) for w, names in holders.items() if w not in FILLER}
    rows = []
    for k, (name, bag) in enumerate(bags):
        x = {w: (1 + math.log(tf)) * idf[w] for w, tf in bag.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rest = 0.0
        for w in sorted(x, key=lambda w: (-idf[w], w), reverse=True):
            rest += (x[w] / norm) ** 2
            rows.append((str(k), name, w, x[w] / norm, rest >= PREFIX_COSINE ** 2))
    return idf, 1 + math.log(1 + n), rows


def nearest(units: DataFrame) -> DataFrame:
    """(key, name, cosine) of the nearest template for every (key, words) that reaches ``MIN_COSINE``; a licence's best template counts."""
    spark = units.sparkSession
    idf, other, rows = weights()
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "w string, idf double"))                       # the templates' words
    posted = F.broadcast(spark.createDataFrame(rows, "template string, name string, w string, x_name double, lead boolean"))  # bounded alike
    terms = (units.select("key", F.explode("words").alias("w")).groupBy("key", "w").agg(F.count("*").alias("tf")).join(known, "w", "left")
             .withColumn("idf", F.coalesce("idf", F.lit(other))).select("key", "w", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("x")))
    rest = Window.partitionBy("key").orderBy("idf", F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)   # from the last word by idf
    terms = (terms.withColumn("rest", F.sum(F.col("x") * F.col("x")).over(rest))
             .withColumn("norm", F.sqrt(F.max("rest").over(Window.partitionBy("key")))))
    leads = terms.filter(F.col("rest") >= F.col("norm") * F.col("norm") * PREFIX_COSINE ** 2)
    pairs = leads.join(posted.filter("lead").select("w", "template"), "w").select("key", "template").distinct()
    cosine = (terms.join(pairs, "key").join(posted.select("template", "name", "w", "x_name"), ["template", "w"])
              .groupBy("key", "template", "name").agg(F.round(F.sum(F.col("x") / F.col("norm") * F.col("x_name")), 6).alias("cosine")))
    return (cosine.filter(F.col("cosine") >= MIN_COSINE).groupBy("key")
            .agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("name").alias("name"))).alias("b"))
            .select("key", F.col("b.name").alias("name"), (-F.col("b.c")).alias("cosine")))


def units(files: DataFrame) -> DataFrame:
    """(file_id, level, words, all_words) of every file as a whole and of its parts that speak of licences."""
    vocabulary = list(weights()[0])

    def licence_words(paragraph: Column) -> Column:
        words = F.transform(F.array(_words(paragraph)), lambda w: F.size(F.filter(w, lambda x: x.isin(vocabulary))) >= F.size(w) * MIN_KNOWN_SHARE)
        return words[0]

    def each(level: int, texts: Column) -> Column:
        return F.transform(F.filter(texts, speaks), lambda t: F.struct(F.lit(level).alias("level"), t.alias("t")))

    text = F.regexp_replace("text", COPYRIGHT, "")
    cut = files.select("file_id", F.regexp_replace(text, r"(?md)^[^A-Za-z0-9\n]*$", "").alias("t"))   # lines without a word are empty
    cut = cut.select("file_id", "t", F.split("t", "\n\n+").alias("paragraphs"))
    marks = F.transform("paragraphs", lambda p: F.when(licence_words(p), p).otherwise(F.lit("\f")))
    regions = F.split(F.array_join(marks, "\n"), "\f")
    out = cut.select("file_id", F.size(_words(F.col("t"))).alias("all_words"), F.explode(F.concat(
        F.array(F.struct(F.lit(WHOLE).alias("level"), F.col("t"))), each(REGION, regions), each(PARAGRAPH, F.col("paragraphs")),
        each(LINE, F.split("t", "\n")), each(SENTENCE, F.flatten(F.transform("paragraphs", lambda p: F.split(p, r"(?<=[.!?;])\s+")))))).alias("u"))
    return out.select("file_id", "u.level", _words(F.col("u.t")).alias("words"), "all_words")


def scan(files: DataFrame) -> DataFrame:
    """(file_id, own, cosine, is_license_file, inherited, license) for (file_id, path, text)."""
    base = files.select("file_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = base.filter(speaks(F.col("text")))                                  # no other file has a notice
    parts = units(spoken)
    distinct = parts.select("words").distinct().withColumn("key", F.xxhash64("words"))   # a notice shared by many files is scored once
    best = nearest(distinct)
    hits = parts.withColumn("key", F.xxhash64("words")).join(best, "key")
    own = hits.groupBy("file_id").agg(
        F.min(F.struct("level", (-F.col("cosine")).alias("c"), F.col("name").alias("name"))).alias("b"),
        F.sum(F.when(F.col("level") == LINE, F.size("words"))).alias("notice_words"), F.max("all_words").alias("all_words"))
    whole = (F.col("b.level") == WHOLE) | F.coalesce(F.col("notice_words") >= F.col("all_words") * MIN_FILE_SHARE, F.lit(False))
    named = F.col("path").rlike(FILE_NAME) & ~F.col("path").rlike(CODE_NAME)
    marked = (base.drop("text").join(own, "file_id", "left")
              .select("file_id", F.regexp_replace("path", "/[^/]*$|^[^/]*$", "").alias("dir"), F.col("b.name").alias("own"), (-F.col("b.c")).alias("cosine"),
                      F.coalesce(whole | (named & F.col("b").isNotNull()), F.lit(False)).alias("is_license_file")))
    held = (marked.filter("is_license_file").groupBy("dir").agg(F.min("own").alias("inherited")))
    # every directory once, with its ancestors from itself up to the root
    dirs = marked.select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("k"), "parts").select(
        F.col("dir").alias("at"), "k", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("dir"))
    near = (up.join(held, "dir").groupBy("at").agg(F.max_by("inherited", "k").alias("inherited")).withColumnRenamed("at", "dir"))
    return (marked.join(near, "dir", "left")
            .select("file_id", "own", "cosine", "is_license_file", "inherited", F.coalesce("own", "inherited").alias("license")))
