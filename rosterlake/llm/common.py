"""Shared helpers of the operators: shared-folder tables, batches, hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (a module of its own: not every worker has it loaded)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.session import ensure_checkpoint_dir, is_classic, ship_package

# The contracts' white space, as code points U+0020, U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
# Arrow rows are processed in slices of about this many text bytes, which bounds
# the arrays a Python worker holds whatever the Arrow batch size is.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


# Spark's own setting: a finished query's shuffle files go at once, not with the driver's next GC.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, partition_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, so a
    lost executor costs no recomputation of what lies behind. The shuffle files of
    the write are of no use after it and are removed with it; the setting holds for
    this write only, whose plan is its own. ``rows_per_file`` bounds what a reader of rows
    of many megabytes holds at a time (0: no bound)."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of ``stored`` tables that nothing will read again. Tables that
    the caller's lazy result still reads must stay; so does everything where the session
    gives no file system (Spark Connect)."""
    for df in tables:
        path, spark = getattr(df, "_stored_at", None), df.sparkSession
        if path and is_classic(spark):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def as_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes; Python then never decodes what it needn't."""
    return F.col(name).cast("binary").alias(name)


def prepare(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    ship_package(spark)
    return spark


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [a, b) whose lengths sum to about ``limit``."""
    a, n = 0, len(lengths)
    total = np.cumsum(lengths)
    while a < n:
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield a, min(b, n)
        a = b


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """(rows, texts) of a batch in slices of bounded text size."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
    for a, b in slices(lengths, limit):
        part = batch.slice(a, b - a)
        yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def plus(schema: T.StructType, **fields: str) -> T.StructType:
    """A copy of ``schema`` with fields added (``StructType.add`` would change the DataFrame's own)."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items())])


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` under a working name that clashes with
    nothing, and the function that gives a result its names and order back."""
    names = {c: c if c in own else f"_shield_{k}" for k, c in enumerate(docs.columns)}
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return out, lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)],
        schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for every pair."""
    starts, lengths = np.asarray(starts, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
    full = lengths > 0
    if not full.all():
        starts, lengths = starts[full], lengths[full]
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]), dtype=np.int64)          # steps; a running sum makes places of them
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out, out=out)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of equal rows in sorted key columns."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], n)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of length ``n`` of the positions inside any [s, s + width)."""
    if n == 0 or len(starts) == 0:
        return np.zeros(n, dtype=bool)
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(np.asarray(starts) + width, n), -1)
    return np.cumsum(d[:-1]) > 0


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_IS_WHITE = np.isin(np.arange(256), [ord(c) for c in WHITE])
_LONG_WORD = 64       # bytes; words beyond are hashed one by one


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, words of each text), A-Z in lower case.

    All words are hashed together, eight bytes a step, and each step is a bijection: words
    of one length of eight bytes or less never clash."""
    import xxhash

    data = b" ".join([*(t or b"" for t in texts), b" " * 8]).lower()
    inside = ~_IS_WHITE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edges[0::2], edges[1::2]                       # the blanks behind close the last word
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    blocks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = end - begin
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, step = np.flatnonzero(length <= _LONG_WORD), 0
    while len(rows):
        block = blocks[begin[rows] + step]
        left = length[rows] - step
        last = np.flatnonzero(left < 8)
        block[last] &= (np.uint64(1) << (np.uint64(8) * left[last].astype(np.uint64))) - np.uint64(1)
        h[rows] = mix(h[rows] ^ block)
        rows, step = rows[left > 8], step + 8
    for k in np.flatnonzero(length > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[begin[k]:end[k]])
    return h, np.diff(np.searchsorted(begin, bounds))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class WindowHash:
    """Hash of every run of ``width`` consecutive symbols in O(n), modulo 2**64.

    H(i) = sum over j < width of x[i + j] * base**(width - 1 - j), from prefix
    sums; ``x`` are 64-bit symbol hashes. Only powers up to the longest input
    are kept."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._n = 0

    def __call__(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        if self._n < n:
            self._n = max(n, 2 * self._n)
            self._up, self._down = powers(self.base, self._n), powers(self.inverse, self._n)
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(x * self._up[:n], out=s[1:])
            h = (s[width:] - s[:-width]) * self._down[: n - width + 1]
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
