"""Line dedup over levelled sorted runs of line hashes.

A store is a folder of runs. A run holds line keys (128-bit hashes), each with the number
of documents that hold it and the largest of them *as of that run*, hashed into
buckets by key and sorted in them, so that run meets run bucket by bucket, without a
shuffle. A batch of documents is reduced to its keys and merge-joined with the runs: a
key that no run holds (the anti join) starts its count, a key that one holds goes on
from there. The outcome is the batch's own run, at level 0. When a level holds ``fanout``
runs they are merged into one run of the next level; a store of n batches holds
O(fanout * log n) runs. A key's newest entry counts: of an older run only what no newer
one holds (anti joins again).

Which lines go follows from the counts of all runs; the texts are then read once more
and cut. A store can be opened again and fed further batches: its folder names say which
batches a run covers, a run counts when its ``_SUCCESS`` file is there, and a run that a
complete wider one covers is ignored. A batch must hold new documents: one that was fed
before would count twice.

Only hashes, counts and ids are shuffled per line; text is shuffled once, by
document id, to meet its list of dropped keys (at most one entry a line).

Defined results: null or empty text is one empty line; rows that share a doc_id
count as one document; a null doc_id counts for no key and loses nothing; an
empty table gives an empty result. Extra columns pass through; one with the name
of a result column gives way to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, plus, prepare, record_batch, shared_path, stored, text_slices

MIN_KEY_CHARS = 20   # fixed value (contract)
MIN_DOCS = 3         # fixed value (contract)
BATCHES = 3          # batches that one whole table is fed in
FANOUT = 2           # runs of a level that are merged into the next

RUN_SCHEMA = "h1 BIGINT, h2 BIGINT, n BIGINT, last BIGINT"
_RUN_NAME = re.compile(r"level=(\d+)/from=(\d+)-to=(\d+)-buckets=(\d+)$")
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])


def _key(line: bytes, min_chars: int) -> bytes | None:
    """bytes.strip and bytes.lower act on ASCII only, as the key is defined."""
    k = line.strip().lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return k


def _hash(key: bytes) -> tuple[int, int]:
    import xxhash

    v = xxhash.xxh3_128_intdigest(key)
    return (v >> 64) - (1 << 63), (v & ((1 << 64) - 1)) - (1 << 63)


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(h1, h2, doc_id): the distinct keys of every document row."""
    prepare(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                out: list[tuple[int, int, int]] = []
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    if text and doc is not None:
                        keys = {k for line in text.split(b"\n") if (k := _key(line, min_chars))}
                        out += [(*_hash(k), doc) for k in keys]
                yield record_batch(_KEYS, zip(*out, strict=True) if out else ([], [], []))

    return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(emit, "h1 long, h2 long, doc_id long")


class LineRuns:
    """The levelled runs of one store, new or opened again, under a shared folder."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        found = self._found()
        whole = [r for r in found if not any(o is not r and o[1] <= r[1] and r[2] <= o[2] and o[0] > r[0] for o in found)]
        self.levels: list[list[tuple[int, int, int, int]]] = [[] for _ in range(1 + max((r[0] for r in whole), default=-1))]
        for r in sorted(whole):
            self.levels[r[0]].append(r)
        self.batches = 1 + max((r[2] for r in whole), default=-1)
        self.buckets = whole[0][3] if whole else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _found(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of the complete runs in the folder."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        pattern = fs_path(f"{self.path}/level=*/*/_SUCCESS")
        states = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern) or []
        names = [_RUN_NAME.search(str(s.getPath().getParent())) for s in states]
        return [tuple(map(int, m.groups())) for m in names if m]

    def runs(self) -> list[tuple[int, int, int, int]]:
        return [r for level in self.levels for r in level]

    def _place(self, run: tuple[int, int, int, int]) -> str:
        return "{}/level={}/from={}-to={}-buckets={}".format(self.path, *run)

    def read(self, run: tuple[int, int, int, int]) -> DataFrame:
        """A run with its buckets known to Spark (the table's name is gone at once: only
        the DataFrame refers to it)."""
        name = f"llm_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN_SCHEMA}) USING parquet OPTIONS (path '{self._place(run)}') "
                       f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {run[3]} BUCKETS")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, df: DataFrame, run: tuple[int, int, int, int]) -> None:
        name = f"llm_run_{uuid.uuid4().hex}"
        (df.select("h1", "h2", "n", "last").write.format("parquet").mode("overwrite").option("compression", "zstd")
         .option("path", self._place(run)).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")            # the files stay
        while len(self.levels) <= run[0]:
            self.levels.append([])
        self.levels[run[0]].append(run)

    def add(self, keys: DataFrame) -> None:
        """Feed one batch of (h1, h2, doc_id), of documents that no batch before it held."""
        batch = (keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))  # a hot key is pre-aggregated by document
                 .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
        self._write(self.merged(batch).repartition(self.buckets, "h1", "h2"), (0, self.batches, self.batches, self.buckets))
        self.batches += 1
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(compact(self._newest_first(old)), (level + 1, min(r[1] for r in old), max(r[2] for r in old), self.buckets))
            self._remove(old)
            level += 1

    def merged(self, batch: DataFrame) -> DataFrame:
        """The batch's keys with their counts as of now: ``fresh`` where no run holds the key."""
        n, last, seen = F.col("n"), F.col("last"), []
        for k, run in enumerate(self.runs()):
            there = self.read(run).select("h1", "h2", F.col("n").alias(f"n{k}"), F.col("last").alias(f"last{k}"))
            batch = batch.join(there, ["h1", "h2"], "left")
            seen.append(k)
        before = F.greatest(F.lit(0), F.lit(0), *[F.col(f"n{k}") for k in seen])            # NULLs are left out
        latest = F.greatest(last, last, *[F.col(f"last{k}") for k in seen])
        return batch.select("h1", "h2", (n + before).alias("n"), latest.alias("last"), (before == 0).alias("fresh"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The anti join: rows of ``keys`` whose key no run holds (first-seen dedup)."""
        for run in self.runs():
            keys = keys.join(self.read(run), ["h1", "h2"], "left_anti")
        return keys

    def totals(self) -> DataFrame:
        if not self.runs():
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return compact(self._newest_first(self.runs()))

    def _newest_first(self, runs: list[tuple[int, int, int, int]]) -> list[DataFrame]:
        return [self.read(r) for r in sorted(runs, key=lambda r: -r[2])]

    def _remove(self, runs: list[tuple[int, int, int, int]]) -> None:
        for run in runs:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(run))
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def compact(runs: list[DataFrame]) -> DataFrame:
    """One row a key over ``runs``, newest first: a run's entries that no newer run holds,
    by merge anti joins on their buckets."""
    out = runs[0]
    for k, run in enumerate(runs[1:], 1):
        for newer in runs[:k]:
            run = run.join(newer.select("h1", "h2"), ["h1", "h2"], "left_anti")
        out = out.unionAll(run)
    return out


def dropped_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS,
                 batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, drop): per document the hashes (h1) and (h2) of the keys whose lines go."""
    spark = docs.sparkSession
    keys = stored(line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")),
                  "line-keys", partition_by="batch")
    store = LineRuns(spark, shared_path(spark, "line-runs"), fanout)
    for b in range(batches):
        store.add(keys.filter(F.col("batch") == b).select("h1", "h2", "doc_id"))
    losing = store.totals().filter(F.col("n") >= min_docs).select("h1", "h2", "last")
    return (keys.join(losing, ["h1", "h2"]).filter(F.col("doc_id") != F.col("last"))
            .groupBy(F.col("doc_id").alias("_l_doc")).agg(F.collect_set(F.struct("h1", "h2")).alias("_l_drop")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped added; rows and other columns stay."""
    prepare(docs)
    docs = docs.drop("kept_text", "n_lines", "n_dropped")   # the results take these names
    drop = dropped_keys(docs, min_chars, min_docs, batches)
    joined = docs.join(drop, docs["doc_id"].cast("long") == drop["_l_doc"], "left").drop("_l_doc")
    joined = joined.withColumn("_l_drop", F.col("_l_drop").cast("array<struct<h1:bigint,h2:bigint>>"))
    cut = joined.withColumn("_l_text", as_bytes("text"))
    names = [f.name for f in docs.schema.fields]
    schema = plus(docs.schema, kept_text="binary", n_lines="long", n_dropped="long")

    def emit(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for part, texts in text_slices(batch, "_l_text"):
                drops = part.column(part.schema.get_field_index("_l_drop")).to_pylist()
                kept, n_lines, n_dropped = [], [], []
                for text, d in zip(texts, drops, strict=True):
                    lines = (text or b"").split(b"\n")
                    n_lines.append(len(lines))
                    if d:
                        gone = {(x["h1"], x["h2"]) for x in d}
                        good = [x for x in lines if not ((k := _key(x, min_chars)) and _hash(k) in gone)]
                        kept.append(b"\n".join(good))
                        n_dropped.append(len(lines) - len(good))
                    else:
                        kept.append(text)
                        n_dropped.append(0)
                cols = [part.column(k) for k in range(len(names))]
                cols += [pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "kept_text", "n_lines", "n_dropped"])

    return cut.mapInArrow(emit, schema).withColumn("kept_text", F.col("kept_text").cast("string"))
