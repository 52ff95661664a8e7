"""Vector expressions and operators; vectors are arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.tables import release, remove, stage, upsert


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and zero norms; within [-1, 1]."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), value).otherwise(0.0)


def vector_search(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(path, score): the k vectors nearest to the one row of query(q), by cosine; ties by path."""
    one = query.limit(1)  # one row
    return vectors.join(F.broadcast(one)).select("path", cosine(F.col("vector"), F.col("q")).alias("score")).orderBy(F.desc("score"), "path").limit(max(k, 0))


#: Queries that go over the vectors together: bounds what is broadcast at once.
BLOCK = 4096
#: Vectors that meet a block of queries in one matrix product, and rows that are held before they are cut to the best.
STEP, HELD = 1024, 1 << 20
#: Cosines by a matrix product are closer than this to those summed in order.
CLOSE = 1e-9


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix padded with zeros, lengths, norms) of a column of arrays; norm 0 where a number is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    long = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    missing = np.asarray(flat.is_null())
    matrix = np.zeros((len(long), int(long.max(initial=0))))
    inside = np.arange(matrix.shape[1]) < long[:, None]
    matrix[inside] = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))
    norms = np.sqrt(_summed(matrix, matrix))
    norms[np.repeat(np.arange(len(long)), long)[missing]] = 0.0
    return matrix, long, norms


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in the order of the components, as `dot` does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _best_of_block(block: pa.Table, k: int):
    """For mapInArrow over (path, vector): the k nearest of a task's vectors for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, long_y, norm_y = _matrix(block.column("q"))
        floor, held = np.full(len(y), -np.inf), []

        def cut() -> None:
            rows = pa.concat_tables(held)
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("slot", "ascending"), ("score", "descending"), ("path", "ascending")], null_placement="at_start"))
            slot = np.asarray(rows.column("slot"))
            keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
            held[:] = [rows.filter(pa.array(keep))]

        for batch in batches:
            paths = batch.column(0)
            every = _matrix(batch.column(1))
            for at in range(0, batch.num_rows, STEP):
                x, long_x, norm_x = (m[at : at + STEP] for m in every)
                wide = min(x.shape[1], y.shape[1])
                with np.errstate(all="ignore"):
                    norms = norm_y[:, None] * norm_x
                    near = (y[:, :wide] @ x[:, :wide].T) / norms
                    # What is no number counts as 1, as in `cosine`.
                    near = np.where((long_y[:, None] == long_x) & ~(norms <= 0), np.where(np.isnan(near), 1.0, np.clip(near, -1.0, 1.0)), 0.0)
                if near.shape[1] > k:
                    floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
                i, j = np.nonzero(near >= floor[:, None] - CLOSE)
                for s in range(0, len(i), 1 << 16):
                    a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    with np.errstate(all="ignore"):
                        norm = norm_y[a] * norm_x[b]
                        value = _summed(y[a, :wide], x[b, :wide]) / norm
                    value = np.where((long_y[a] == long_x[b]) & ~(norm <= 0), np.where(np.isnan(value), 1.0, np.clip(value, -1.0, 1.0)), 0.0)
                    held.append(pa.table({"slot": a, "path": paths.take(pa.array(at + b)), "score": value}))
                    if sum(map(len, held)) > HELD:
                        cut()
        if held:
            cut()
            rows = held[0]
            out = pa.table({"query_id": block.column("query_id").take(rows.column("slot")), "path": rows.column("path"), "score": rows.column("score")})
            yield from out.combine_chunks().to_batches(1 << 16)

    return run


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, path, score, rank) for queries(query_id, q), by cosine; ties by path.

    Queries are dealt to blocks of about BLOCK; each block goes over all vectors by matrix products, those near its k best
    are summed again in order, and each task leaves k rows a query.  A null q scores 0 with everything; query ids are
    expected not to repeat; k below 1 gives none.
    """
    asked = stage(queries.select("query_id", "q"), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    kinds = StructType([asked.schema["query_id"], vectors.schema["path"], StructField("score", DoubleType())])
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        scored = vectors.select("path", "vector").mapInArrow(_best_of_block(block, max(k, 1)), kinds)
        best = stage(scored.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        out = best if out is None else out.unionByName(best)
    release(asked)
    return out


def vector_upsert(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """vectors with rows put in by path; of rows that repeat a path one stays, a null path is added as it is."""
    return upsert(vectors, rows, "path")


def vector_remove(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    """vectors without those paths; null and unknown paths take nothing out."""
    return remove(vectors, paths, "path")
