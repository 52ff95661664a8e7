"""Tables kept in parts by a hash of their key: an upsert or a removal writes the parts that it touches and no others.

A part is a partition folder.  What a touched part will hold is staged first, then that folder alone is replaced (dynamic
partition overwrite).  A run that is cut off leaves each part as it was or as it will be, and the same upsert or removal
run again completes it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import file_system, read_text, release, remove, save, stage, upsert, write_text

PARTS = 64


def overwrite_parts(df: DataFrame, path: str, touched: list, part: str = "part") -> None:
    """Replaces the parts `touched` of the table at path by df's rows, all of which lie in them; a part without rows goes."""
    spark = df.sparkSession
    staged = stage(df.repartition(F.col(part)), "parts")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    left = {r[part] for r in staged.select(part).distinct().collect()}  # as many as parts at most
    for p in set(touched) - left:
        fs, folder = file_system(spark, f"{path}/{part}={p}")
        fs.delete(folder, True)
    release(staged)


class PartTable:
    """A table at a path, in `parts` parts by its key."""

    def __init__(self, spark: SparkSession, path: str):
        layout = json.loads(read_text(spark, f"{path}/_parts.json") or "{}")
        if not layout:
            raise FileNotFoundError(f"no table in parts at {path}")
        self.spark, self.path, self.key, self.parts = spark, path, layout["key"], layout["parts"]
        self.schema = T.StructType.fromJson(layout["schema"])

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, parts: int = PARTS) -> PartTable:
        """Writes df; what was at path is replaced.  Rows that repeat a key stay as they are until that key is put."""
        spark = df.sparkSession
        save(df.withColumn("part", cls._part(F.col(f"`{key}`"), parts)).repartition("part"), path, "part")
        write_text(spark, f"{path}/_parts.json", json.dumps({"key": key, "parts": parts, "schema": df.schema.jsonValue()}))
        return cls(spark, path)

    @staticmethod
    def _part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop("part")

    def get(self, value) -> DataFrame:
        """The rows of one key: its part alone is read."""
        part = self.spark.range(1).select(self._part(F.lit(value), self.parts)).first()[0]
        return self._all().where((F.col("part") == part) & (F.col(f"`{self.key}`") == F.lit(value))).drop("part")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._part(F.col(f"`{self.key}`"), self.parts)).distinct().collect())

    def _replace(self, parts: list[int], rows: DataFrame) -> None:
        overwrite_parts(rows.withColumn("part", self._part(F.col(f"`{self.key}`"), self.parts)), self.path, parts)

    def put(self, rows: DataFrame) -> list[int]:
        """Puts rows in by key, over those that have it (as `upsert` does); returns the parts that were written."""
        named = rows.where(F.col(f"`{self.key}`").isNotNull())
        parts = self._touched(named)
        if parts:
            old = self._all().where(F.col("part").isin(parts)).drop("part")
            self._replace(parts, upsert(old, named, self.key).select(*old.columns))
        return parts

    def drop(self, keys: DataFrame) -> list[int]:
        """Takes the rows of keys(key) out; returns the parts that were written."""
        parts = self._touched(keys.where(F.col(f"`{self.key}`").isNotNull()))
        if parts:
            old = self._all().where(F.col("part").isin(parts)).drop("part")
            self._replace(parts, remove(old, keys, self.key))
        return parts
