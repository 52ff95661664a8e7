"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to principal axes, so most of a product is known after a few leading dimensions.
Rows are gathered by their nearest of a number of centres that grows with the table, and dealt to tiles of
bounded size.  Before any vector moves, pairs of centres are ruled out whose rows lie in boxes (on all axes)
or balls that are farther apart than two linked vectors can be.  Inside a pair of tiles, products accumulate
over blocks of dimensions; what is left is bounded by the product of suffix norms, and rows and columns that
cannot reach the threshold any more are left out.  What survives is decided by the cosine of the original
vectors in double precision.

Exact copies are one vector with a multiplicity.  A pair of tiles returns counts of links and a spanning
forest of them, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import arrow_batches, release, stage
from .vectors import centres, distances, matrix, usable

SIMILAR = 0.9
#: Vectors the axes and centres are fitted on, at most; they order the work and change no result.
FITTED = 20_000
#: Rows of a centre on average, centres at most, rows of a tile and of a block of it that is compared at once.
GATHERED, CENTRES, TILE, BLOCK = 2048, 1024, 4096, 512
_SLACK = 1e-9
_BLOCKS = (8, 16, 32)


def _fitted(rows: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes as columns, by falling variance, and centres on them, from the rows with the least hashes."""
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(FITTED).select("vector").toArrow()
    if not sample.num_rows:
        return np.eye(width), np.zeros((1, width))
    x = matrix(sample.column("vector"), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
    axes = np.ascontiguousarray(axes[:, ::-1])
    return axes, centres(x @ axes, max(1, min(CENTRES, total // GATHERED)))


def _near(boxes: list, middle: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a <= b) of centres whose rows can be within `side` of each other, by their boxes and balls."""
    ids = np.array([r["centre"] for r in boxes], dtype=np.int64)
    low, high = (np.array([np.frombuffer(r[c], np.float64) for r in boxes]) for c in ("low", "high"))
    radius = np.array([r["radius"] for r in boxes])
    first, second = [], []
    for i in range(len(ids)):  # at most CENTRES
        gap = np.maximum(np.maximum(low - high[i], low[i] - high), 0)
        apart = np.sqrt((gap * gap).sum(1))
        apart = np.maximum(apart, distances(middle[ids[i : i + 1]], middle[ids])[0] - radius[i] - radius)
        hit = np.flatnonzero((apart <= side) & (ids >= ids[i]))
        first.append(np.full(len(hit), ids[i]))
        second.append(ids[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _survivors(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that still have a pair which can reach `least`, accumulating leading dimensions."""
    i, j = np.arange(len(a)), np.arange(len(b))
    width, at = a.shape[1], 0
    products = np.zeros((len(a), len(b)))
    rest = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(1), 0))
    for end in [*(d for d in _BLOCKS if d < width), width]:
        products += a[i, at:end] @ b[j, at:end].T
        can = products + rest(a[i], end)[:, None] * rest(b[j], end)[None, :] >= least - _SLACK
        keep_i, keep_j = can.any(1), can.any(0)
        if not keep_i.any():
            return i[:0], j[:0]
        if keep_i.mean() < 0.9 or keep_j.mean() < 0.9:
            i, j, products = i[keep_i], j[keep_j], products[keep_i][:, keep_j]
        at = end
    return i, j


def _forest(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Least node that each of n nodes reaches over the edges (rows, columns)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[columns])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tied(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches) over edges: as many as nodes, not as edges."""
    nodes = np.unique(np.concatenate([first, second]))
    return nodes, nodes[_forest(np.searchsorted(nodes, first), np.searchsorted(nodes, second), len(nodes))]


def _compared(axes, width: int, similar: float):
    """(key, links, b): links of a vector inside a pair of tiles, and one edge that ties it in.

    A pair of tiles is compared block by block: whole rows of a small block can be left out sooner.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["same"]
                ids = [np.frombuffer(row[k], np.int64) for k in ("keys", "keys2")]
                n = [np.frombuffer(row[k], np.int64) for k in ("counts", "counts2")]
                x = [np.frombuffer(row[k], row[t]).astype(np.float64).reshape(-1, width) for k, t in (("vectors", "kind"), ("vectors2", "kind2"))]
                norm = [np.sqrt((v * v).sum(1)) for v in x]
                turned = [(v / r[:, None]) @ axes.value[0] for v, r in zip(x, norm)]
                links = [np.zeros(len(ids[0]), np.int64)]
                links.append(links[0] if same else np.zeros(len(ids[1]), np.int64))
                edges: list[tuple[np.ndarray, np.ndarray]] = []
                for p in range(0, len(ids[0]), BLOCK):
                    for q in range(p if same else 0, len(ids[1]), BLOCK):
                        i, j = _survivors(turned[0][p : p + BLOCK], turned[1][q : q + BLOCK], similar)
                        if not len(i):
                            continue
                        i, j = i + p, j + q
                        hit = (x[0][i] @ x[1][j].T) / (norm[0][i][:, None] * norm[1][j][None, :]) >= similar
                        if same and p == q:
                            hit &= i[:, None] < j[None, :]
                        r, c = np.nonzero(hit)
                        if len(r):
                            np.add.at(links[0], i[r], n[1][j[c]])
                            np.add.at(links[1], j[c], n[0][i[r]])
                            edges.append(_tied(ids[0][i[r]], ids[1][j[c]]))
                if not edges:
                    continue
                nodes, least = _tied(*(np.concatenate(e) for e in zip(*edges)))
                keys, counts = (np.concatenate(v[:1] if same else v) for v in (ids, links))
                order = np.argsort(keys)
                found = counts[order][np.searchsorted(keys[order], nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found), pa.array(least)], names=["key", "links", "b"])

    return run


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, ...).

    Rows link when the cosine of their embeddings, in double precision, is at least `similar`; n_links counts
    the other rows that a row links with, copies included, component_id is the smallest vec_id reachable.
    Embeddings that are null, empty, zero or hold a null or non-finite component link with nothing, nor do
    rows whose vec_id is null (component_id null, kept true).  Embeddings of unequal length are filled up
    with zeros.  Repeated rows are rows of their own.  Other columns are not read.  Empty table: no rows.
    """
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    live = every.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=True))
    # One row for each different vector, named by its least vec_id; a vec_id may repeat, so the key does not.
    named = stage(live.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vectors")
    total, width = named.agg(F.count("*"), F.max(F.size("vector"))).first()
    key = F.monotonically_increasing_id()
    rows = stage(named.select("vec_id", "n", "vector", key.alias("key")), "vectors")
    if not total:
        width = 1
    axes, middle = _fitted(rows, width, total)
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast((axes, middle))
    # Unit vectors are at most this far apart when they link.
    side = math.sqrt(max(2 - 2 * similar, 1e-9)) + 1e-6

    def placed(batches):
        turn, to = held.value
        for batch in batches:
            x = matrix(batch.column(2), width)
            turned = (x / np.sqrt((x * x).sum(1))[:, None]) @ turn
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(distances(turned, to).argmin(1).astype(np.int32))], names=["key", "n", "raw", "centre"])

    gathered = stage(rows.select("key", "n", "vector").mapInArrow(placed, "key long, n long, raw binary, centre int"), "gathered")
    sizes = gathered.groupBy("centre").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # CENTRES rows at most
    dealt = gathered.join(F.broadcast(sizes), "centre").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        turn, to = held.value
        centre, tile = table.column("centre")[0].as_py(), table.column("tile")[0].as_py()
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(-1, width)
        turned = (x / np.sqrt((x * x).sum(1))[:, None]) @ turn
        kind = "<f4" if (x.astype(np.float32) == x).all() else "<f8"  # doubles that are floats travel as such
        keys, n = (np.asarray(table.column(c)).astype(np.int64).tobytes() for c in ("key", "n"))
        row = {"centre": pa.array([centre], pa.int32()), "tile": pa.array([tile], pa.int32()), "kind": [kind]}
        row |= {k: pa.array([v], pa.binary()) for k, v in (("keys", keys), ("counts", n), ("vectors", x.astype(kind).tobytes()), ("low", turned.min(0).tobytes()), ("high", turned.max(0).tobytes()))}
        return pa.table(row | {"radius": [float(distances(turned, to[centre : centre + 1]).max())]})

    tiles = stage(dealt.groupBy("centre", "tile").applyInArrow(packed, "centre int, tile int, kind string, keys binary, counts binary, vectors binary, low binary, high binary, radius double"), "tiles")

    def boxed(table: pa.Table) -> pa.Table:
        ends = [f(np.stack([np.frombuffer(v, np.float64) for v in table.column(c).to_pylist()]), axis=0).tobytes() for f, c in ((np.min, "low"), (np.max, "high"))]
        return pa.table({"centre": table.column("centre")[:1], "low": pa.array([ends[0]], pa.binary()), "high": pa.array([ends[1]], pa.binary()), "radius": [max(table.column("radius").to_pylist())]})

    boxes = tiles.select("centre", "low", "high", "radius").groupBy("centre").applyInArrow(boxed, "centre int, low binary, high binary, radius double").collect()
    a, b = _near(boxes, middle, side)
    near = spark.createDataFrame(pa.table({"centre": pa.array(a.astype(np.int32)), "centre2": pa.array(b.astype(np.int32))}))
    spots = tiles.select("centre", "tile")
    # Bounded by CENTRES * CENTRES / 2 pairs of numbers.
    pairs = spots.join(F.broadcast(near), "centre").join(spots.select(F.col("centre").alias("centre2"), F.col("tile").alias("tile2")), "centre2")
    here = F.col("centre") == F.col("centre2")
    pairs = stage(pairs.where(~here | (F.col("tile") <= F.col("tile2"))).withColumn("same", here & (F.col("tile") == F.col("tile2"))), "pairs")
    whole = tiles.drop("low", "high", "radius")
    other = whole.select(*[F.col(c).alias(f"{c}2") for c in whole.columns])
    both = pairs.join(whole, ["centre", "tile"]).join(other, ["centre2", "tile2"]).select("same", "kind", "keys", "counts", "vectors", "kind2", "keys2", "counts2", "vectors2")
    with arrow_batches(spark, 64):  # rows are pairs of tiles
        found = stage(both.mapInArrow(_compared(held, width, similar), "key long, links long, b long"), "links")

    # Groups of vectors, then of rows: the least vec_id in a group of vectors is the least of its rows.
    groups = connected_components(found.select(F.col("key").alias("a"), "b"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    tied = rows.select("key", "vec_id", "n", "vector").join(counts, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    tied = stage(tied.withColumn("component", F.coalesce("component", "key")).withColumn("links", F.coalesce("links", F.lit(0))), "tied")
    least = tied.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    least = stage(least, "least")
    named_groups = stage(tied.join(least, "component").select("vector", "n", "links", "component_id"), "groups")
    release(named, rows, gathered, tiles, pairs, found, groups, tied, least)
    out = every.withColumn("live", F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=True))
    out = out.withColumn("vector", F.when(F.col("live"), F.col("vector")))
    out = out.join(named_groups, "vector", "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
