"""Nearest vectors by cosine similarity (X13): exact, and through an index of cells.

Exact: the corpus is dealt by a hash of its ids into parts of about ``PART_ROWS`` rows,
the queries into tiles of about ``TILE_ROWS``; every (part, tile) pair is one group of
a cogroup on that key. A group is one matrix product; it gives at most k rows a query,
and a ranked window brings the parts together. Nothing is collected on the driver,
no size changes the path and no set is too large.

Index: cell centroids are fitted on a bounded sample (``FIT_ROWS`` rows), and *every*
vector goes to its nearest cell. A query looks into the cells nearest to it: as many as
sampled vectors need to find ``RECALL`` of their own neighbours (all cells, if directions
have no structure). A cell
that holds many rows (one vector may be a third of the corpus) is split into slices
of about ``PART_ROWS`` by a hash of the ids; its queries go to every slice.

Vectors that are missing, of another length than the queries or zero have no
neighbours and are no neighbours. Equal similarities are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.numeric import round_half_up
from rosterlake.plans.broadcast import broadcast_bounded
from rosterlake.session import ship_package

DEFAULT_TOP_K = 8
PART_ROWS = 20_000           # corpus rows of one group
TILE_ROWS = 2_048            # query rows of one group
FIT_ROWS = 100_000           # corpus rows that the cells are fitted on, at most
NEARLY = 1e-9                # similarities this close are compared once more
MAX_CELLS = 4_096
FIT_ROUNDS = 8
FIT_QUERIES = 200            # sampled vectors that set the number of cells to look into
RECALL = 0.95                # share of the sample's neighbours that must be found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(corpus: pa.Table, queries: pa.Table, k: int, names: tuple[str, str]) -> pa.Table:
    """The k nearest rows of ``corpus`` (id, vector) for every row of ``queries``."""
    kind = pa.schema([("query_id", pa.int64()), (names[0], pa.int64()), ("similarity", pa.float64())])
    if not corpus.num_rows or not queries.num_rows:
        return kind.empty_table()
    ids, mat = np.asarray(corpus.column(names[0]), dtype=np.int64), _matrix(corpus.column(names[1]))
    q_ids, q_mat = np.asarray(queries.column("query_id"), dtype=np.int64), _matrix(queries.column("query_vector"))
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = (mat @ q_mat.T) / (np.linalg.norm(mat, axis=1)[:, None] * np.linalg.norm(q_mat, axis=1)[None, :])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(len(q_ids)):
        s = sims[:, j]
        near = ~np.isnan(s)             # a zero vector has no direction: no neighbour
        if k < near.sum():              # only what reaches the k-th place is looked at again
            near &= s >= np.partition(s[near], -k)[-k] - NEARLY
        near = np.flatnonzero(near)
        # row by row: a matrix product's last digits depend on its shape, and equal vectors must tie
        s = (mat[near] * q_mat[j]).sum(axis=1) / (np.sqrt((mat[near] ** 2).sum(axis=1)) * np.sqrt((q_mat[j] ** 2).sum()))
        order = np.lexsort((ids[near], -s))[:k]
        out.append((np.full(len(order), q_ids[j]), ids[near][order], s[order]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=kind)


def _usable(corpus: DataFrame, queries: DataFrame, dim: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())
    return (corpus.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col)).where(whole(vec_col)),
            queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"))
            .where(whole("query_vector")))


def _ranked(partial: DataFrame, k: int, id_col: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(id_col).asc())
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_col, round_half_up(F.col("similarity"), 6).alias("similarity")))


def _joined(corpus: DataFrame, queries: DataFrame, keys: list[str], k: int, id_col: str, vec_col: str) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k, (id_col, vec_col))

    partial = corpus.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(score, f"query_id long, {id_col} long, similarity double")
    return _ranked(partial, k, id_col)


def _dealt(c: str, parts: int | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def nearest_vectors(corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K,
                    id_col: str = "vec_id", vec_col: str = "embedding",
                    part_rows: int = PART_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Exact cosine top-k of every query (query_id, query_vector) over the corpus."""
    ship_package(corpus.sparkSession)
    parts = max(1, math.ceil(corpus.count() / part_rows))          # from the files' footers
    asked, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("query_vector")), F.lit(0))).first()
    tiles = max(1, math.ceil(asked / tile_rows))
    c, q = _usable(corpus, queries, dim, id_col, vec_col)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("_part", _dealt(id_col, parts)).withColumn("_tile", every(tiles) if tiles > 1 else F.lit(0))
    q = q.withColumn("_tile", _dealt("query_id", tiles)).withColumn("_part", every(parts) if parts > 1 else F.lit(0))
    return _joined(c, q, ["_part", "_tile"], k, id_col, vec_col)


# ----------------------------------------------------------------------------- index
@dataclass(frozen=True)
class Cells:
    """Centroids (cells x dimension) and the number of cells that a query looks into."""

    centres: np.ndarray
    probes: int


def _nearest_cell(mat: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(mat[a:a + 4096] @ centres.T, axis=1) for a in range(0, len(mat), 4096)])


def fit_cells(corpus: DataFrame, cells: int | None = None, k: int = DEFAULT_TOP_K, vec_col: str = "embedding", id_col: str = "vec_id",
              seed: int = 7) -> Cells:
    """Cells of directions, fitted on at most ``FIT_ROWS`` rows (by the least hashes of
    their ids); their number is the square root of the corpus size by default, MAX_CELLS
    at most."""
    n = corpus.count()
    cells = min(cells or max(1, round(math.sqrt(n))), MAX_CELLS)
    # a hash threshold picks about FIT_ROWS rows wherever they lie
    share = F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).cast("double") / 2.0 ** 63      # even in [-1, 1)
    sample = corpus.where(share < 2.0 * FIT_ROWS / max(n, 1) - 1.0) if n > FIT_ROWS else corpus
    rows = sample.select(F.col(vec_col).cast("array<double>").alias("v")).where("v is not null").toArrow()
    vectors = [x for x in rows.column("v").to_pylist() if x and None not in x]
    width = max((len(x) for x in vectors), default=0)
    whole = [x for x in vectors if len(x) == width]
    mat = np.array(whole, dtype=np.float64) if whole else np.zeros((0, width))
    mat = mat[np.linalg.norm(mat, axis=1) > 0]
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    mat = np.unique(mat, axis=0)                                     # copies don't draw cells
    if not len(mat):
        return Cells(np.zeros((0, width)), 0)
    mat = mat[np.random.default_rng(seed).permutation(len(mat))]
    centres = mat[:cells]
    for _ in range(FIT_ROUNDS):
        owner = _nearest_cell(mat, centres)
        total = np.zeros_like(centres)
        np.add.at(total, owner, mat)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return Cells(centres, _probes(mat, centres, _nearest_cell(mat, centres), k))


def _probes(mat: np.ndarray, centres: np.ndarray, owner: np.ndarray, k: int) -> int:
    """Cells to look into so that RECALL of the nearest vectors of sampled ones are found."""
    some = mat[:FIT_QUERIES]
    sims = some @ mat.T
    sims[np.arange(len(some)), np.arange(len(some))] = -2.0          # a vector doesn't look for itself
    near = np.argsort(-sims, axis=1, kind="stable")[:, :min(k, max(len(mat) - 1, 1))]
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1, kind="stable"), axis=1)     # of each cell, for each query
    needed = np.sort(np.take_along_axis(place, owner[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))]) + 1


def _cells_of(df: DataFrame, vec_col: str, centres: np.ndarray, nearest: int) -> DataFrame:
    """``df`` plus _cell, once for each of a vector's ``nearest`` cells."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(centres)          # MAX_CELLS x dimension at most
    base = df.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mat = _matrix(pa.chunked_array([batch.column(base.index(vec_col))]))
            near = np.argsort(-(mat @ sent.value.T), axis=1, kind="stable")[:, :nearest]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], names=[*base, "_cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(emit, f"{kinds}, _cell int")


def build_index(corpus: DataFrame, cells: Cells, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every usable vector with its cell: write it partitioned or bucketed by ``_cell``."""
    c = corpus.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col))
    whole = F.col(vec_col).isNotNull() & (F.size(vec_col) == cells.centres.shape[1]) & ~F.exists(vec_col, lambda x: x.isNull())
    return _cells_of(c.where(whole), vec_col, cells.centres, 1)


def search_index(index: DataFrame, cells: Cells, queries: DataFrame, k: int = DEFAULT_TOP_K, probes: int | None = None,
                 id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """Top-k of every query among the vectors of its ``probes`` nearest cells (by default as
    many as the fit found necessary)."""
    centres, probes = cells.centres, cells.probes if probes is None else probes
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"))
    whole = F.col("query_vector").isNotNull() & (F.size("query_vector") == centres.shape[1]) & ~F.exists("query_vector", lambda x: x.isNull())
    q = _cells_of(q.where(whole), "query_vector", centres, min(probes, max(len(centres), 1)))
    sizes = index.groupBy(F.col("_cell").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_slices"))
    sizes = broadcast_bounded(sizes, MAX_CELLS, "one row per cell")
    c = index.join(sizes, F.col("_cell") == F.col("_c")).withColumn("_slice", _dealt(id_col, F.col("_slices"))).drop("_c", "_slices")
    q = (q.join(sizes, F.col("_cell") == F.col("_c"))
         .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_c", "_slices"))
    return _joined(c, q, ["_cell", "_slice"], k, id_col, vec_col)
