"""Exact top-k inner products by pivot-table elimination.

Scores are integer inner products of quantised vectors.  One more coordinate, sqrt(M - |c|^2) with M the
largest squared norm, gives all candidates one norm, so that the largest product is the least Euclidean
distance.  A table of distances from every candidate to many pivots is made once; a query's own distances
to the pivots then bound its distance to each candidate from below by the largest difference (the triangle
inequality).  Candidates lie in tiles by their nearest pivot; a tile also keeps the least and the largest
distance of its rows to each pivot, so that one bound can rule out the whole tile.  Tiles are taken in the
order of their bounds, candidates of a tile in the order of theirs, until the next bound cannot beat the
k-th best score so far.  That score starts as the k-th best in a sample of the candidates, which is never too
high, and is carried from tile to tile and batch to batch.

Queries go over all tiles in blocks of a fixed number of queries, one block after another: what is broadcast
does not grow and is given back, and a block's answers are cut to k a query before they are written.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import arrow_batches, release, shared_dir, stage
from .vectors import centres, distances, matrix, narrowest, usable

SCALE = 1024
PIVOTS = 64
#: Queries of a block on average: bounds a broadcast to some MB.
BLOCK = 4096
#: Rows that pivots are chosen from and first scores are taken from, those with the least hashes; the choice changes the work, not the result.
CHOSEN_FROM = 4096
#: Candidates of a tile on average at the most, and those evaluated between two looks at the stopping rule.
TILE, _STEP = 2048, 256
#: Distances are kept in 32 bits: what bounds are lowered by, as a share of how far things can be apart.
_SLACK = 2e-6

_FOUND = "query_id long, vec_id long, score long, evaluated long"


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))[:, None]])


def _first(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some candidates, its own row left out; less than any score if they are too few."""
    out = np.full(len(q), -np.inf)
    for at in range(0, len(q), 256):
        part = np.rint(q[at : at + 256] @ x.T)
        part[own[at : at + 256, None] == ids[None, :]] = -np.inf
        if part.shape[1] >= k:
            out[at : at + 256] = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
    return out


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.evaluated = 0

    def least(self) -> float:
        """A score that a candidate must reach to matter; ties need a smaller id, so they matter."""
        return max(self.floor, self.scores[-1]) if len(self.scores) >= self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.evaluated += len(scores)
        near = scores >= self.least()
        scores, ids = np.concatenate([self.scores, scores[near]]), np.concatenate([self.ids, ids[near]])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]


def _reaches(bound: np.ndarray, reach: float, least: float) -> np.ndarray:
    """Whether something at these distances or beyond can have a score of `least`."""
    d = np.maximum(bound - _SLACK * np.sqrt(reach), 0)
    return (reach - d * d) / 2 + 0.5 >= least


def _look(best: _Best, own: int, query: np.ndarray, far: np.ndarray, reach: float, tile: tuple) -> None:
    """Evaluates a tile's candidates in the order of their bounds until the next cannot reach the k best."""
    ids, x, table = tile
    bound = np.abs(table - far[None, :]).max(1)
    order = np.flatnonzero(_reaches(bound, reach, best.least()))
    order = order[np.argsort(bound[order], kind="stable")]
    for at in range(0, len(order), _STEP):
        part = order[at : at + _STEP]
        if not _reaches(bound[part[:1]], reach, best.least())[0]:
            break
        part = part[ids[part] != own]
        best.add(np.rint(x[part] @ query).astype(np.int64), ids[part])


def _tiles(vectors: DataFrame, is_query: Column, scale: int):
    """Staged tiles, staged queries, the pivots, a sample of the candidates (ids, vectors), the width and the largest squared norm."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    live = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
    live = live.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    whole = stage(live.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"), F.coalesce("asks", F.lit(False)).alias("asks")), "whole")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = whole.agg(F.max(F.size("vector")).alias("width"), F.max(square).alias("largest"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most"), F.count("*").alias("n")).first()
    width, largest, kind = facts["width"] or 1, facts["largest"] or 0.0, narrowest(facts["most"] or 0.0)
    spark = vectors.sparkSession
    sample = whole.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(CHOSEN_FROM).select("vec_id", "vector").toArrow()
    chosen = matrix(sample.column("vector"), width) if sample.num_rows else np.zeros((0, width))
    pivots = centres(_lifted(chosen, largest), PIVOTS, rows=True)
    held = spark.sparkContext.broadcast(pivots)

    def tabled(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            far = distances(_lifted(x, largest), held.value)
            raw, table = np.ascontiguousarray(x.astype(kind)), np.ascontiguousarray(far.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far.argmin(1).astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary())], names=["vec_id", "pivot", "raw", "far"])

    def packed(table: pa.Table) -> pa.Table:
        one = lambda c: b"".join(table.column(c).to_pylist())
        far = np.frombuffer(one("far"), np.float32).reshape(table.num_rows, -1)
        row = [np.asarray(table.column("vec_id")).astype(np.int64).tobytes(), one("raw"), far.tobytes(), far.min(0).tobytes(), far.max(0).tobytes()]
        return pa.table([pa.array([x], pa.binary()) for x in row], names=["ids", "raw", "far", "low", "high"])

    table = stage(whole.select("vec_id", "vector").mapInArrow(tabled, "vec_id long, pivot int, raw binary, far binary"), "pivots")
    sizes = table.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # PIVOTS rows at most
    dealt = table.join(F.broadcast(sizes), "pivot").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    tiles = stage(dealt.groupBy("pivot", "tile").applyInArrow(packed, "ids binary, raw binary, far binary, low binary, high binary"), "tiles")
    asking = stage(whole.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    release(whole, table)
    held.destroy()
    return tiles, asking, pivots, (np.asarray(sample.column("vec_id")), chosen), width, largest, kind


def _answers(vectors: DataFrame, is_query: Column, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score, evaluated): each query's k best, and one row without vec_id that counts what was evaluated."""
    spark = vectors.sparkSession
    tiles, asking, pivots, (sample_ids, sample), width, largest, kind = _tiles(vectors, is_query, scale)
    path, number = f"{shared_dir(spark)}/foliolake/found-{uuid.uuid4().hex}", asking.count()
    spark.createDataFrame([], _FOUND).write.parquet(path)
    blocks = max(1, -(-number // BLOCK)) if number else 0
    for b in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if block.num_rows > 2 * BLOCK:
            raise ValueError("a block of queries is far larger than a hash would deal")
        ids, q = np.asarray(block.column("vec_id")), matrix(block.column("vector"), width)
        far = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
        held = spark.sparkContext.broadcast((ids, q, far, _first(q, ids, sample, sample_ids, k)))
        found = tiles.mapInArrow(_asked(held, width, largest, k, kind), _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")
        best = found.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) | F.col("vec_id").isNull()).drop("r")
        with arrow_batches(spark, 64):  # rows are tiles
            best.write.mode("append").parquet(path)
        held.destroy()
    release(tiles, asking)
    return spark.read.schema(_FOUND).parquet(path)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row of vectors that is_query holds for.

    vectors(vec_id, embedding, ...): a component x counts as floor(scale * x), x as double; the score is the
    integer inner product, ties go to the smaller vec_id.  Candidates are all rows but those that share the
    query's vec_id; fewer than k give all.  Rows whose vec_id is null, or whose embedding is null, empty or
    holds a null or non-finite component, take no part; unequal lengths are filled up with zeros; a vec_id
    that repeats asks once, with its first vector in array order, and each of its rows is a candidate.
    Products must fit in 53 bits.  Other columns are not read.  Empty table, or no query: no rows.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _answers(vectors, is_query, k, scale).where("vec_id is not null")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def evaluated(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, evaluated): how many candidates had their product computed; the others were ruled out by bounds."""
    return _answers(vectors, is_query, k, scale).where("vec_id is null").groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))


def _asked(block, width: int, largest: float, k: int, kind: np.dtype):
    def run(batches):
        own, q, q_far, floors = block.value
        best = [_Best(k, f) for f in floors]
        reach = (q * q).sum(1) + largest
        for batch in batches:
            tiles, low, high = [], [], []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                tiles.append((ids, np.frombuffer(row["raw"], kind).reshape(len(ids), width).astype(np.float64), np.frombuffer(row["far"], np.float32).reshape(len(ids), -1)))
                low.append(np.frombuffer(row["low"], np.float32))
                high.append(np.frombuffer(row["high"], np.float32))
            if not tiles:
                continue
            low, high = np.stack(low).astype(np.float64), np.stack(high).astype(np.float64)
            for r in range(len(own)):
                bounds = np.maximum(np.maximum(low - q_far[r], q_far[r] - high).max(1), 0)
                for t in np.argsort(bounds, kind="stable"):
                    if not _reaches(bounds[t : t + 1], reach[r], best[r].least())[0]:
                        break
                    _look(best[r], int(own[r]), q[r], q_far[r].astype(np.float32), reach[r], tiles[t])
        for b, name in zip(best, own):
            ids, scores = [*b.ids.tolist(), None], [*b.scores.tolist(), None]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name)), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array([0] * (len(ids) - 1) + [b.evaluated], pa.int64())], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run
