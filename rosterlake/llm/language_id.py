"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training: every learning document's 1- to 3-grams of lower-cased letters (other
characters are one blank) are hashed into a fixed number of buckets and counted
by language inside each task; the counts are summed by Spark over all documents
and the log-probability matrix (languages x buckets, a size fixed by the
parameters) is broadcast. Scoring: a batch's n-grams index the matrix and are
summed by document with numpy (a sparse product); the score is the posterior
probability of the best language.

Defined results: text that is null or has no letter is ``und`` with score 0; with
nothing to learn from, every document is ``und``; ties go to the language first
in order. Language names come from the data; more than ``MAX_LANGUAGES`` is an
error, as the broadcast's bound would not hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix, plus, prepare, text_slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
MAX_LANGUAGES = 500
UNKNOWN = "und"
HELD_OUT_REMAINDER, FOLDS = 2, 4      # fixed values (contract)

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_REMAINDER, F.lit(False))


def code_points(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, lower case, runs of others as one blank, each text
    inside blanks: (code points, number per text; 0 for a text without letters)."""
    parts, sizes = [], []
    for t in texts:
        s = _NOT_LETTERS.sub(" ", t.decode("utf-8", "replace")).lower().strip() if t else ""
        if s and any(map(str.isalpha, s)):
            s = f" {s} "
            parts.append(s)
            sizes.append(len(s))
        else:
            sizes.append(0)
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    return flat, np.array(sizes, dtype=np.int64)


def gram_buckets(flat: np.ndarray, sizes: np.ndarray, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text it belongs to); grams never cross texts."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, own = [], []
    for n in orders:
        if len(flat) < n:
            continue
        m = len(flat) - n + 1
        with np.errstate(over="ignore"):
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + flat[k:k + m]
        inside = owner[:m] == owner[n - 1:]
        out.append((mix(h)[inside] % np.uint64(buckets)).astype(np.int64))
        own.append(owner[:m][inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(own)


def gram_counts(labelled: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang), pre-added in each task."""
    prepare(labelled)
    out_schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                langs = part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    flat, sizes = code_points([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    b, _ = gram_buckets(flat, sizes, buckets, orders)
                    total.setdefault(lang, np.zeros(buckets, np.int64))[:] += np.bincount(b, minlength=buckets)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(counts[at], pa.int64())], schema=out_schema)

    rows = labelled.select(as_bytes("text"), "lang").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(emit, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS,
          smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """(languages, float32 matrix buckets x languages of log probabilities). Class
    priors are uniform, so a frequent language doesn't win short texts."""
    grouped = gram_counts(labelled, buckets, orders).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"))   # at most ``buckets`` cells a language
    rows = sorted(grouped.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((buckets, len(rows)))
    for k, r in enumerate(rows):
        cells = np.array([(c["bucket"], c["n"]) for c in r["cells"]], dtype=np.int64)
        counts[cells[:, 0], k] = cells[:, 1]
    p = (counts + smoothing) / (counts.sum(axis=0) + smoothing * buckets)
    return [r["lang"] for r in rows], np.log(p).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """``docs`` without text, plus lang_pred and score; no shuffle."""
    spark = prepare(docs)
    sent = spark.sparkContext.broadcast((languages, matrix))
    base = [f.name for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    df = docs.select(*base, as_bytes("text").alias("_i_text"))
    schema = plus(docs.select(*base).schema, lang_pred="string", score="double")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = sent.value
        buckets = len(logp)
        for batch in batches:
            for part, texts in text_slices(batch, "_i_text"):
                flat, sizes = code_points(texts)
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                if names and len(flat):
                    b, own = gram_buckets(flat, sizes, buckets, orders)
                    total = np.stack([np.bincount(own, weights=logp[b, k], minlength=len(texts)) for k in range(len(names))], axis=1)
                    top = total.argmax(axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    has = sizes > 0
                    best[has], score[has] = top[has], (1.0 / odds.sum(axis=1))[has]
                cols = [part.column(k) for k in range(len(base))]
                cols += [pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*base, "lang_pred", "score"])

    return df.mapInArrow(emit, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all."""
    names, matrix = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), names, matrix)
