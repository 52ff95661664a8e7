"""Tables between the steps of an operator, as the library stages them, and the size of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import arrow_batches, file_system, read_text, release, shared_dir, stage, write_text

__all__ = ["arrow_batches", "file_system", "parts_of", "read_text", "release", "shared_dir", "stage", "stage_mapped", "write_text"]

#: Whole texts handed to Python at once: rows, and bytes unless one text alone is longer.
ROWS, BYTES = 2048, 32 << 20


def stage_mapped(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """stage, for a df whose Python functions take whole texts: batches are small while it is written."""
    with arrow_batches(df.sparkSession, ROWS, BYTES):
        return stage(df, label, codec)


def parts_of(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at once: for results that are computed when somebody else reads them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
