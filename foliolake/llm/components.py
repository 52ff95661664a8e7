"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each round is joins and
aggregations over the edge list only; a hub's edges are never brought together: its least neighbour is a
partially aggregated minimum, joined back to the edges by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage


def _toward_minimum(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(u, v) with m, the least of u and its v; the staged minima are returned for release."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m")), least


def connected_components(edges: DataFrame) -> DataFrame:
    """Staged (node, component) for every node of edges(a long, b long); component is its least reachable node.

    Loops, repeated edges and edges with a null end are ignored; a node that has no other edge is not
    returned.  No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stage(e, "edges")
    before = None
    while True:
        print_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not print_["n"] or print_ == before:
            break
        before = print_
        both, least = _toward_minimum(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = stage(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small, least2 = _toward_minimum(large)
        small = small.select("u", "v", "m")
        after = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
        release(now, least, large, least2)
        now = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stage(members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    release(now)
    return out
