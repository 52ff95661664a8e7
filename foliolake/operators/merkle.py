"""A stored Merkle tree of source hashes: what changed between two states is found from the root down.

A leaf's place is the SHA-256 of its path: nodes are prefixes of its hexadecimal digits, so that one change touches the
nodes of one prefix chain and moves no other leaf.  The deepest nodes are buckets, whose hash is that of their leaves in
order of path; a node above hashes its children's digits and hashes in order.  All levels are kept, in parts by the first
two digits; an update rewrites those parts alone that its changes fall into.  (`merkle_root` is the other tree, over
positions of sorted leaves, whose root the compile state records.)
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parts import overwrite_parts
from ..sources.tables import read_text, save, stage, write_text

#: Leaves of a bucket on average, and changed nodes of a level that are looked up by a list; with more, by a join.
BUCKET, LISTED = 64, 1000
_TOP = "top"


def _placed(leaves: DataFrame, depth: int) -> DataFrame:
    """(prefix, path, source_hash, part) of the last row of each path; rows without a path are no leaves."""
    rows = leaves.where("path is not null").groupBy("path").agg(F.max("source_hash").alias("source_hash"))
    placed = rows.select(F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"), "path", F.coalesce("source_hash", F.lit("")).alias("source_hash"))
    return placed.withColumn("part", _part(F.col("prefix")))


def _part(prefix: Column) -> Column:
    return F.when(F.length(prefix) >= 2, F.left(prefix, F.lit(2))).otherwise(F.lit(_TOP))


def _buckets(placed: DataFrame, depth: int) -> DataFrame:
    """Nodes (level, prefix, hash, n) of the deepest level; a bucket's leaves are few, whatever their number in all."""
    inside = F.array_sort(F.collect_list(F.concat("path", F.lit("\0"), "source_hash")))
    return placed.groupBy("prefix").agg(F.sha2(F.array_join(inside, "\n"), 256).alias("hash"), F.count("*").alias("n")).select(F.lit(depth).alias("level"), "prefix", "hash", "n")


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level from those of the level below, sixteen at most to each."""
    child = F.concat(F.right("prefix", F.lit(1)), F.lit(":"), "hash")
    up = nodes.groupBy(F.left("prefix", F.lit(level)).alias("up")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("hash"), F.sum("n").alias("n"))
    return up.select(F.lit(level).alias("level"), F.col("up").alias("prefix"), "hash", "n")


class Tree:
    """A tree kept below a root folder: nodes(level, prefix, hash, n) and leaves(prefix, path, source_hash), in parts."""

    def __init__(self, spark: SparkSession, root: str):
        text = read_text(spark, f"{root}/_tree.json")
        if text is None:
            raise FileNotFoundError(f"no tree at {root}")
        self.spark, self.root, self.depth = spark, root, json.loads(text)["depth"]

    @classmethod
    def build(cls, leaves: DataFrame, root: str, depth: int | None = None) -> Tree:
        """Writes the tree of leaves(path, source_hash); depth: digits of a bucket's prefix, by default from their number.

        Two trees can be compared if their depths are equal; a null hash counts as an empty one.
        """
        spark = leaves.sparkSession
        if depth is None:
            depth = max(1, math.ceil(math.log(max(1, leaves.count() / BUCKET), 16)))
        placed = stage(_placed(leaves, depth), "leaves")
        level = stage(_buckets(placed, depth), "nodes")
        every = level
        for k in range(depth - 1, -1, -1):
            level = stage(_above(level, k), "nodes")
            every = every.unionByName(level)
        save(placed.repartition("part").sortWithinPartitions("prefix", "path"), f"{root}/leaves", "part")
        save(every.withColumn("part", _part(F.col("prefix"))).repartition("part").sortWithinPartitions("level", "prefix"), f"{root}/nodes", "part")
        write_text(spark, f"{root}/_tree.json", json.dumps({"depth": depth}))
        return cls(spark, root)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("level int, prefix string, hash string, n long, part string").parquet(f"{self.root}/nodes")

    def leaves(self) -> DataFrame:
        return self.spark.read.schema("prefix string, path string, source_hash string, part string").parquet(f"{self.root}/leaves")

    def root_hash(self) -> str | None:
        """None for a tree without leaves."""
        row = self.nodes().where(f"part = '{_TOP}' and level = 0").select("hash").first()
        return row["hash"] if row else None

    def _of(self, rows: DataFrame, prefixes: DataFrame, up: Column) -> DataFrame:
        """Those rows whose prefix (shortened by `up`) is among prefixes."""
        few = [r["prefix"] for r in prefixes.limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return rows.join(prefixes.select(F.col("prefix").alias("up")), up == F.col("up"), "left_semi")
        parts = sorted({p[:2] for p in few if len(p) >= 2})
        inside = rows.where(F.col("part").isin(parts)) if few and len(parts) and all(len(p) >= 2 for p in few) else rows
        return inside.where(up.isin(few))

    def update(self, changes: DataFrame) -> int:
        """Puts changes(path, source_hash) in, a null hash takes its path out; returns how many nodes were written.

        Nodes off the changed prefix chains stay as they are, and parts without one are not written.
        """
        depth = self.depth
        new = stage(changes.where("path is not null").groupBy("path").agg(F.max("source_hash").alias("source_hash")).select(F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"), "path", "source_hash"), "changes")
        touched = stage(new.select("prefix").distinct(), "touched")
        parts = sorted(r[0] for r in touched.select(_part(F.col("prefix"))).distinct().collect())  # 257 at most
        if not parts:
            return 0
        leaves = self.leaves().where(F.col("part").isin(parts))
        kept = leaves.join(new.select("path"), "path", "left_anti").select("prefix", "path", "source_hash", "part")
        now = stage(kept.unionByName(new.where("source_hash is not null").withColumn("part", _part(F.col("prefix")))), "leaves")
        level = stage(_buckets(now.join(touched, "prefix", "left_semi"), depth), "nodes")
        written, frontier = level, touched
        gone = touched.join(level.select("prefix"), "prefix", "left_anti")
        removed = gone.select(F.lit(depth).alias("level"), "prefix")
        for k in range(depth - 1, -1, -1):
            parents = stage(frontier.select(F.left("prefix", F.lit(k)).alias("prefix")).distinct(), "parents")
            siblings = self._of(self.nodes().where(F.col("level") == k + 1), parents, F.left("prefix", F.lit(k)))
            others = siblings.join(frontier, "prefix", "left_anti").select("level", "prefix", "hash", "n")
            level = stage(_above(others.unionByName(level), k), "nodes")
            written = written.unionByName(level)
            removed = removed.unionByName(parents.join(level.select("prefix"), "prefix", "left_anti").select(F.lit(k).alias("level"), "prefix"))
            frontier = parents
        fresh = stage(written, "written")
        old = self.nodes().where(F.col("part").isin([*parts, _TOP]))
        off = old.join(fresh.select("level", "prefix").unionByName(removed), ["level", "prefix"], "left_anti").select("level", "prefix", "hash", "n", "part")
        overwrite_parts(now, f"{self.root}/leaves", parts)
        overwrite_parts(off.unionByName(fresh.withColumn("part", _part(F.col("prefix")))), f"{self.root}/nodes", [*parts, _TOP])
        return fresh.count()


def compare(old: Tree, new: Tree) -> tuple[DataFrame, int]:
    """((path, change), nodes read): change is added, removed or changed; only differing subtrees are gone into."""
    if old.depth != new.depth:
        raise ValueError(f"trees of depths {old.depth} and {new.depth}")
    spark, read, frontier = old.spark, 0, None
    for level in range(old.depth + 1):
        sides = []
        for tree in (old, new):
            rows = tree.nodes().where(F.col("level") == level)
            if level < 2:
                rows = rows.where(f"part = '{_TOP}'")
            if frontier is not None:
                rows = tree._of(rows, frontier, F.left("prefix", F.lit(level - 1)))
            sides.append(stage(rows.select("prefix", "hash"), "side"))
        read += sides[0].count() + sides[1].count()
        both = sides[0].withColumnRenamed("hash", "before").join(sides[1], "prefix", "full_outer")
        frontier = stage(both.where(~F.col("before").eqNullSafe(F.col("hash"))).select("prefix"), "differing")
        if frontier.isEmpty():
            return spark.createDataFrame([], "path string, change string"), read
    a, b = (t._of(t.leaves(), frontier, F.col("prefix")).select("path", F.col("source_hash").alias(n)) for t, n in ((old, "before"), (new, "now")))
    rows = a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("now")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return rows.select("path", change.alias("change")), read
