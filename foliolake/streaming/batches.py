"""A folder of files extracted in micro-batches: each file is read once, and counts arrive while the run goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE
from ..sources.files import EXTRACTORS, extract_structured
from ..sources.tables import small_files
from .streams import incremental_files


def batch_process_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.pdf", most: int = 100, extractor: str = "text", report: Callable[[int, int, int], None] | None = None, rounds: int = 64) -> DataFrame:
    """Extracts the folder's files into the Parquet table at `out`, `most` at a time; returns that table, a row for each page.

    Of a folder with more than most * rounds files a micro-batch takes more of them, so that there are `rounds` batches and
    not as many as the folder is large: each one costs the same, whatever it holds.

    After each micro-batch report(done, failed, total) gets counts of files: total are those listed when the run began.
    The counts are observed in the very job that writes the pages.  A file that fails has a row with its error, as in
    extract_structured.  A run that was cut off goes on from its checkpoint, and one over the same files again adds none;
    a batch's pages lie in a folder of their own, which a second attempt replaces.
    """
    if extractor not in EXTRACTORS:
        raise KeyError(f"no extractor {extractor}")
    with small_files(spark):
        total = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).count()  # lists, reads no content
    counts = {"done": 0, "failed": 0}

    def run(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        # Every file has one row that begins it: page 1, or page 0 with its error.
        pages = extract_structured(batch, extractor).observe(seen, F.count_if(F.col("page_number") <= 1).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        pages.write.mode("overwrite").parquet(f"{out}/batch={number}")
        for k in counts:
            counts[k] += seen.get[k]
        if report:
            report(counts["done"], counts["failed"], total)

    files = incremental_files(spark, folder, glob, max(most, -(-total // rounds)))
    with small_files(spark):
        files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{PAGE}, error string, batch int").parquet(out).drop("batch")
