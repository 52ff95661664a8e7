"""Staged tables and snapshots in the shared folder of the cluster.

A staged table cuts lineage and survives the loss of executors.  It goes to the folder that the cluster names
in ``spark.checkpoint.dir``; only a local master may leave that unset (tests, a laptop).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset a local master gets a local folder; any other raises, since each executor would write
    to a disk of its own and reads would come back incomplete.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return LOCAL


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Writes df once, with the session's codec or the one given, and returns a scan of what was written."""
    path = f"{shared_dir(df.sparkSession)}/foliolake/{label}-{uuid.uuid4().hex}"
    with brief_shuffles(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to tasks by a hash of columns.

    Tables come in as few tasks as their files have row groups; rows that cost much each (a file to write, a text to
    parse) must not wait for one another there.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as one of its own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def release(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file in one step: a reader sees the old text or the new, never neither."""
    fs, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    replace_file(spark, draft, path)


def replace_file(spark: SparkSession, draft, path: str) -> None:
    """Moves a draft (a Hadoop path) to path in one step, over what is there."""
    fs = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    option = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(path), overwrite)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, object]) -> Iterator[None]:
    """The session has these settings while what is inside runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brief_shuffles(spark: SparkSession):
    """What is shuffled inside is deleted when each query ends, not when the driver happens to collect its garbage.

    Meant for writes: a write has a plan of its own, which nothing runs again.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def arrow_batches(spark: SparkSession, rows: int, size: int = 32 << 20):
    """At most `rows` rows and about `size` bytes are handed to Python at once while actions run inside."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size})


def small_files(spark: SparkSession):
    """Inside, Spark looks up files by as many tasks as there are cores, not by one for each, and reads thousands by one task, not 32.

    A file stream looks up each micro-batch's files anew, by the settings of the session that it was made in: they have to
    hold until it ends.
    """
    return settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.sparkContext.defaultParallelism, "spark.sql.files.openCostInBytes": 1 << 16})


def _old(path: str) -> str:
    return f"{path.rstrip('/')}.old"


def save(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the snapshot at path, also when df reads it; with `by`, in folders by those columns.

    The new one is written beside it, then the old one steps aside and the new one takes its place.  A crash
    between these two renames leaves the old one beside the path, where `load` finds it.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(fresh, partitionBy=list(by) or None)
    swap(spark, fresh, path)


def swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the folder fresh in path's place; `settle` finds the old one if this is cut off."""
    fs, target = file_system(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(_old(path))
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"{path} could not step aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), target):
        raise OSError(f"{fresh} could not be renamed to {path}")
    fs.delete(old, True)


def settle(spark: SparkSession, path: str) -> None:
    """Brings back what a swap that was cut off between its renames had moved aside."""
    fs, target = file_system(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(_old(path))
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)


def load(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot at path; one that is missing or lacks required columns is rebuilt, or raises without rebuild."""
    settle(spark, path)
    try:
        df = spark.read.parquet(path)
        if set(required) <= set(df.columns):
            return df
        problem: Exception = ValueError(f"{path} lacks {sorted(set(required) - set(df.columns))}")
    except AnalysisException as e:
        problem = e
    if rebuild is None:
        raise problem
    save(rebuild(), path)
    return spark.read.parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows of the same key replaced and the others added.

    Of rows that repeat a key one stays: the last by the order of the other columns, nulls first.  Rows without
    a key are added as they are.  Columns that one side lacks are null there.
    """
    named = rows.where(F.col(f"`{key}`").isNotNull())
    last = named.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key], key)).alias("row")).select("row.*").select(*rows.columns)
    kept = table.join(named.select(key).distinct(), key, "left_anti").select(*table.columns)
    return kept.unionByName(last, allowMissingColumns=True).unionByName(rows.where(F.col(f"`{key}`").isNull()), allowMissingColumns=True)


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it lacks: what is there stays."""
    return table.unionByName(rows.join(table.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key is in keys; a null key matches nothing, repeats in keys do not matter."""
    return table.join(keys.select(key).distinct(), key, "left_anti")
