"""The relational tables with data: partitioned Parquet with VARIANT metadata and Bloom filters on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RELATIONAL
from .tables import swap

#: Of each table, what it is partitioned by and the columns that are looked up by value.
LAYOUT: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "extracted_documents": (("schema_name",), ("id", "source_file")),
    "processing_tasks": (("status",), ("id", "file_path")),
    "validation_records": ((), ("id", "document_id")),
    "audit_logs": (("action",), ("id", "resource_id")),
    "schema_definitions": ((), ("id", "name")),
}


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """rows as the table has them: its columns in order, missing ones null; JSON strings become variants, broken ones null."""
    wanted = T.StructType.fromDDL(RELATIONAL[name])
    if unknown := set(rows.columns) - set(wanted.names):
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    given = {f.name: f.dataType for f in rows.schema.fields}

    def column(f: T.StructField):
        if f.name not in given:
            return F.lit(None).cast(f.dataType).alias(f.name)
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.VariantType) and not isinstance(given[f.name], T.VariantType):
            return F.try_parse_json(own.cast("string")).alias(f.name)
        return own.cast(f.dataType).alias(f.name)

    return rows.select(*[column(f) for f in wanted.fields])


def write_table(rows: DataFrame, root: str, name: str, distinct: int = 1_000_000, group_bytes: int | None = None) -> None:
    """Replaces the table below root by rows.

    Looked-up columns get Bloom filters of some `distinct` values a file, so that a lookup reads only the row groups that
    may hold the value; group_bytes is the size of a row group.
    """
    by, looked_up = LAYOUT[name]
    fresh = f"{root}/{name}.new"
    out = conformed(rows, name).write.mode("overwrite")
    for c in looked_up:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    if group_bytes:
        out = out.option("parquet.block.size", str(group_bytes))
    out.parquet(fresh, partitionBy=list(by) or None)
    swap(rows.sparkSession, fresh, f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table below root; a table that is not there raises."""
    return spark.read.schema(RELATIONAL[name]).parquet(f"{root}/{name}")
