"""Incremental compilation: content hashes against a state table, Merkle root, versions, records."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import insert_missing, read_text, remove, stage, upsert, write_text


def needs_compile(sources: DataFrame, state: DataFrame) -> DataFrame:
    """sources(path, content) with source_hash and needs_compile: new, changed, or compiled to nothing."""
    hashed = sources.select("path", F.sha2("content", 256).alias("source_hash"))
    known = state.select("path", F.col("source_hash").alias("old_hash"), "compiled_entries")
    stale = F.col("old_hash").isNull() | ~F.col("old_hash").eqNullSafe(F.col("source_hash")) | (F.coalesce(F.size("compiled_entries"), F.lit(0)) <= 0)
    return hashed.join(known, "path", "left").select("path", "source_hash", stale.alias("needs_compile"))


def get_pending_sources(sources: DataFrame, state: DataFrame) -> DataFrame:
    """(path) of what needs_compile holds for; null contents count as changed, paths that repeat come as often."""
    return needs_compile(sources, state).where("needs_compile").select("path")


def get_compilation_state(state: DataFrame, path: str) -> DataFrame:
    """The state's rows of one path: one, or none if it was never compiled."""
    return state.where(F.col("path") == path)


def incremental_plan(sources: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action): compile or skip."""
    return needs_compile(sources, state).select("path", F.when(F.col("needs_compile"), "compile").otherwise("skip").alias("action"))


def incremental_totals(results: DataFrame) -> DataFrame:
    """One row of results(action, error): what failed is neither compiled nor skipped."""
    done = F.col("error").isNull()
    return results.agg(F.count("*").alias("scanned"), F.count_if((F.col("action") == "compile") & done).alias("compiled"), F.count_if(F.col("action") == "skip").alias("skipped"))


def stale_by_instruction(state: DataFrame, instruction_hash: str) -> DataFrame:
    """Sources compiled under another instruction, or none."""
    return state.where(~F.col("instruction_hash").eqNullSafe(F.lit(instruction_hash))).select("path")


def record_compile(state: DataFrame, records: DataFrame) -> DataFrame:
    """state with records put in by path; of records that repeat a path the last by its columns stays."""
    return upsert(state, records, "path")


def forget(state: DataFrame, paths: DataFrame) -> DataFrame:
    """state without those paths; null and unknown ones take nothing out."""
    return remove(state, paths, "path")


def leaf_sort(leaves: DataFrame) -> DataFrame:
    """(path, source_hash) by path, nulls first; paths are expected not to repeat, else their order is open."""
    return leaves.select("path", "source_hash").orderBy("path")


@F.pandas_udf(T.StringType())
def _merkle(leaves: pd.Series) -> pd.Series:
    def root(hashes):
        level = [bytes.fromhex(h) for h in hashes]
        while len(level) > 1:
            level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0].hex() if level else None

    return leaves.map(root)


def merkle_root(leaves: DataFrame, fan: int = 4096) -> DataFrame:
    """One row (root): pairs of SHA-256 values in path order, hashed upward; an odd last one moves up as it is.

    Runs of `fan` leaves, a power of two, are whole subtrees: each is folded where it lies, so no task holds
    more than `fan` leaves.
    """
    if fan & (fan - 1):
        raise ValueError("fan must be a power of two")
    rows = leaves.select("path", "source_hash").repartitionByRange("path").sortWithinPartitions("path")
    part = stage(rows.withColumn("part", F.spark_partition_id()), "leaves").withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1)
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    level = part.join(F.broadcast(base), "part").select((F.col("base") + F.col("at")).alias("at"), F.col("source_hash").alias("h"))
    while True:
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("l")).select("at", _merkle(F.transform("l", lambda x: x["h"])).alias("h"))
        level = stage(level, "merkle")
        if level.count() <= 1:
            return level.select(F.col("h").alias("root"))


def has_changes(leaves: DataFrame, saved_root: str | None) -> DataFrame:
    """One row: whether the Merkle root is another than the saved one; no leaves have no root, equal to no saved one."""
    return merkle_root(leaves).select((~F.col("root").eqNullSafe(F.lit(saved_root))).alias("has_changes"))


def migrate_from_json(files: DataFrame) -> DataFrame:
    """Compile state from JSON texts(value) of either shape: {"entries": {path: record}} or {path: record}."""
    record = "struct<source_hash:string,compiled_entries:array<string>,last_compiled:string,instruction_hash:string,model_id:string>"
    nested = F.from_json("value", f"struct<entries:map<string,{record}>>")["entries"]
    flat = F.from_json("value", f"map<string,{record}>")
    both = files.select(F.explode(F.coalesce(nested, flat)).alias("path", "r"))
    return both.where(F.col("r.source_hash").isNotNull()).select("path", "r.*")


def export_json(table: DataFrame, key: str = "path") -> DataFrame:
    """(value): each record as {key: record}; one JSON object a line."""
    rest = [c for c in table.columns if c != key]
    return table.select(F.to_json(F.map_from_arrays(F.array(key), F.array(F.struct(*rest)))).alias("value"))


def recompile_entry(entries: DataFrame, versions: DataFrame, path: str, now: Column, new_hash: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, versions, outcome): the old row goes to versions, the current one is marked for recompiling.

    outcome(path, old_version, new_version, source_changed, backup) has a row if path is there.
    """
    me = entries.where(F.col("path") == path)
    stem = F.regexp_replace("path", r"\.md$", "")
    outcome = me.select("path", F.col("version").alias("old_version"), (F.col("version") + 1).alias("new_version"), (~F.col("source_hash").eqNullSafe(F.lit(new_hash))).alias("source_changed"), F.format_string("%s_v%d.md", stem, "version").alias("backup"))
    here = F.col("path") == path
    current = entries.withColumn("version", F.when(here, F.col("version") + 1).otherwise(F.col("version"))).withColumn("status", F.when(here, "needs_recompile").otherwise(F.col("status"))).withColumn("updated", F.when(here, now).otherwise(F.col("updated")))
    return current, versions.unionByName(me, allowMissingColumns=True), outcome


def sql_upsert(schemas: DataFrame, defaults: DataFrame, now: Column) -> DataFrame:
    """Default schemas by name where missing (what is there is not touched), stamped."""
    return insert_missing(schemas, defaults.withColumn("updated_at", now), "name")


def set_meta(meta: DataFrame, key: str, value: bytes) -> DataFrame:
    """meta(key, value binary) with the key's value replaced or added."""
    return upsert(meta, meta.sparkSession.createDataFrame([(key, bytearray(value))], "key string, value binary"), "key")


def get_meta(meta: DataFrame, key: str) -> bytes | None:
    """The key's value; None if there is none."""
    row = meta.where(F.col("key") == key).select("value").first()
    return bytes(row["value"]) if row else None


_STATUS = "running boolean, last_started string, last_finished string, last_duration_ms long, last_outcome string, entries_compiled long, entries_skipped long, message string"
#: Where a knowledge base keeps the status of its last compilation.
STATUS_FILE = "_index/compile_status.json"


def write_compile_status(spark: SparkSession, root: str, compiled: int, skipped: int, finished: str, duration_ms: int = 0) -> None:
    """Replaces the status of the last compilation below root."""
    # The outcome and the message.
    record = {"running": False, "last_finished": finished, "last_outcome": "success", "last_duration_ms": duration_ms, "entries_compiled": compiled, "entries_skipped": skipped, "message": f"Incremental compile: {compiled} compiled, {skipped} skipped"}
    write_text(spark, f"{root}/{STATUS_FILE}", json.dumps(record))


def get_compile_status(spark: SparkSession, root: str) -> DataFrame:
    """One row: the status below root; before any compilation all is null but running (false) and the message."""
    text = read_text(spark, f"{root}/{STATUS_FILE}")
    record = json.loads(text) if text else {"running": False, "message": "No compile has been performed yet."}
    fields = [f.split()[0] for f in _STATUS.split(", ")]
    return spark.createDataFrame([tuple(record.get(f) for f in fields)], _STATUS)
