"""Aggregations over tool calls, metric samples, tasks and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stage

# Bounds of the duration histogram in seconds, as they are written, and the families' names and helps.
BUCKETS = ("0.1", "0.5", "1", "2", "5", "10", "20", "30")
DEGRADATIONS = ("vlm_degradations_total", "Total number of VLM degradations", "counter")
DURATION = ("vlm_request_duration_seconds", "VLM request duration in seconds", "histogram")
REQUESTS = ("vlm_requests_total", "Total number of VLM requests", "counter")


def tool_metrics(calls: DataFrame, errors_add_latency: bool = True) -> DataFrame:
    """(tool, calls, avg_latency_ms, errors, success_rate) of calls(tool, latency_ms, success).

    The mean is a whole number, rounded down; the rate is 100 without calls.
    """
    counted = F.count("*") if errors_add_latency else F.count_if("success")
    latency = F.sum("latency_ms") if errors_add_latency else F.sum(F.when(F.col("success"), F.col("latency_ms")))
    a = calls.groupBy("tool").agg(F.count("*").alias("calls"), counted.alias("n"), F.coalesce(latency, F.lit(0)).alias("total"), F.count_if(~F.col("success")).alias("errors"))
    mean = F.when(F.col("n") > 0, F.floor(F.col("total") / F.col("n"))).otherwise(0)
    return a.select("tool", "calls", mean.cast("long").alias("avg_latency_ms"), "errors", (100.0 * (F.col("calls") - F.col("errors")) / F.col("calls")).alias("success_rate"))


def tool_totals(calls: DataFrame) -> DataFrame:
    """One row over all tools; without calls the rate is 100 and the mean 0.  A null success counts as neither."""
    n = F.count("*")
    return calls.agg(n.alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.when(n > 0, F.floor(F.sum("latency_ms") / n)).otherwise(0).cast("long").alias("avg_latency_ms"), F.when(n > 0, 100.0 * F.count_if("success") / n).otherwise(100.0).alias("success_rate"))


def metric_window_agg(samples: DataFrame, window: int) -> DataFrame:
    """One row over the last `window` samples(ts, value, key): avg, min, max, p99, count; 0: all of them.

    p99 is the element at place floor(n * 0.99), from 0; without samples everything is 0.
    """
    last = samples.orderBy(F.desc("ts"), F.desc("key")).limit(window) if window else samples
    a = last.agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))
    p99 = _at_place(last.select("value"), F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1) + 1)
    return a.crossJoin(p99).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg", "min", "max", "p99")], "count")


def _at_place(values: DataFrame, place) -> DataFrame:
    """One row (p99): the value at an exact place, from 1, of the sorted values; `place` is made from their number n.

    Equal values are counted first; the counts are dealt out by range of value, and prefix sums of the ranges'
    totals say which range holds the place: no task sees more than its range.
    """
    counts = values.where("value is not null").groupBy("value").agg(F.count("*").alias("c")).repartitionByRange("value")
    placed = stage(counts.withColumn("part", F.spark_partition_id()), "counts")
    totals = placed.groupBy("part").agg(F.sum("c").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy()).alias("n"))
    inside = placed.join(F.broadcast(ranges), "part").withColumn("upto", F.col("base") + F.sum("c").over(Window.partitionBy("part").orderBy("value")))
    return inside.agg(F.min(F.when(F.col("upto") >= place, F.col("value"))).alias("p99"))


def extraction_statistics(docs: DataFrame, now) -> DataFrame:
    """By schema: all, those of the last day and week, mean processing time from the metadata, those with data.

    The metadata may be JSON text or a VARIANT; a time that is no whole number, and broken JSON, count as none.
    """
    age = F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    if isinstance(docs.schema["extraction_metadata"].dataType, T.VariantType):
        ms = F.try_variant_get("extraction_metadata", "$.processing_time_ms", "string").try_cast("int")
    else:
        ms = F.get_json_object("extraction_metadata", "$.processing_time_ms").try_cast("int")
    return docs.groupBy("schema_name").agg(
        F.count("*").alias("total"), F.count_if(age < 86400).alias("last_24h"), F.count_if(age < 7 * 86400).alias("last_7d"), F.avg(ms).alias("avg_ms"), F.count_if(F.col("data").isNotNull()).alias("with_data"),
    )


def task_statistics(tasks: DataFrame) -> DataFrame:
    """By schema: tasks by state, and mean seconds of the finished ones."""
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")]
    return tasks.groupBy("schema_name").agg(F.count("*").alias("total"), *states, F.avg(F.when(F.col("status") == "completed", seconds)).alias("avg_seconds"))


def batch_stats(results: DataFrame) -> DataFrame:
    """One row of results(status, duration_ms): success, failed, progress in percent, rounded mean duration."""
    done = F.count_if(F.col("status").isin("success", "failed"))
    mean = F.avg(F.when(F.col("status") == "success", F.col("duration_ms")))
    return results.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.when(F.count("*") > 0, F.round(100.0 * done / F.count("*"))).otherwise(0.0).alias("progress"), F.coalesce(F.round(mean), F.lit(0.0)).alias("avg_duration"))


def exec_log_stats(log: DataFrame) -> DataFrame:
    """One row: success rate (100 without rows) and mean latency."""
    n = F.count("*")
    return log.agg(F.when(n > 0, 100.0 * F.count_if("success") / n).otherwise(100.0).alias("success_rate"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"))


def last_n(log: DataFrame, n: int, ts: str = "ts", key: str = "key") -> DataFrame:
    """The newest n rows, newest first."""
    return log.orderBy(F.desc(ts), F.desc(key)).limit(n)


def domain_distribution(entries: DataFrame) -> DataFrame:
    """(domain, n, share) with shares in percent of all entries."""
    n = entries.groupBy("domain").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("domain", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def vlm_requests(requests: DataFrame) -> DataFrame:
    """(provider, status, n) of requests(provider, status, seconds)."""
    return requests.groupBy("provider", "status").agg(F.count("*").alias("n"))


def vlm_degradations(degradations: DataFrame) -> DataFrame:
    """(reason, n) of degradations(reason); a null reason is written as no text."""
    return degradations.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def vlm_durations(requests: DataFrame) -> DataFrame:
    """One row: the histogram's cumulative counts b0, b1, ..., its count and sum.  Only successful requests are observed."""
    seen = requests.where("status = 'success' and seconds is not null")
    counts = [F.count_if(F.col("seconds") <= float(b)).alias(f"b{k}") for k, b in enumerate(BUCKETS)]
    return seen.agg(*counts, F.count("*").alias("count"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("sum"))


def vlm_histogram(requests: DataFrame) -> DataFrame:
    """(le, n): cumulative counts of successful requests up to each bound, and of all."""
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BUCKETS)]
    return vlm_durations(requests).select(F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))))


def exposition(requests: DataFrame, degradations: DataFrame) -> DataFrame:
    """(line_no, line): the three families as text, by name, each with its help and type; families without samples are left out."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), "\n", r"\\n"), '"', r'\\"')
    # A cast would write 1.0E7 from ten million on.
    number = lambda c: F.when(c.cast("double").isNotNull() & (F.abs(c.cast("double")) < 1e18), F.regexp_replace(F.format_string("%.17f", c.cast("double")), r"\.?0+$", "")).otherwise(c.cast("string"))
    one = lambda family, k, key, line: (F.lit(family).alias("family"), F.lit(k).alias("k"), key.alias("key"), line.alias("line"))
    label = F.concat(F.lit(f'{DEGRADATIONS[0]}{{reason="'), escaped(F.col("reason")), F.lit('"} '), F.col("n").cast("string"))
    rows = vlm_degradations(degradations).select(*one(DEGRADATIONS[0], 2, F.col("reason"), label))
    held = vlm_durations(requests).where("count > 0")
    bounds = [F.struct(F.lit(f"{k:02d}").alias("key"), F.concat(F.lit(f'{DURATION[0]}_bucket{{le="{b}"}} '), F.col(c).cast("string")).alias("line")) for k, (b, c) in enumerate([*((b, f"b{k}") for k, b in enumerate(BUCKETS)), ("+Inf", "count")])]
    ends = [F.struct(F.lit(f"{90 + k}").alias("key"), F.concat(F.lit(f"{DURATION[0]}_{c} "), number(F.col(c))).alias("line")) for k, c in enumerate(("sum", "count"))]
    rows = rows.unionByName(held.select(F.inline(F.array(*bounds, *ends))).select(*one(DURATION[0], 2, F.col("key"), F.col("line"))))
    label = F.concat(F.lit(f'{REQUESTS[0]}{{provider="'), escaped(F.col("provider")), F.lit('",status="'), escaped(F.col("status")), F.lit('"} '), F.col("n").cast("string"))
    rows = rows.unionByName(vlm_requests(requests).select(*one(REQUESTS[0], 2, F.concat_ws("\x01", "provider", "status"), label)))
    heads = [(n, k, "", t) for n, h, t in (DEGRADATIONS, DURATION, REQUESTS) for k, t in enumerate((f"# HELP {n} {h}", f"# TYPE {n} {t}"))]
    heads = requests.sparkSession.createDataFrame(heads, "family string, k int, key string, line string")
    rows = rows.unionByName(heads.join(rows.select("family").distinct(), "family", "left_semi"))
    # One row for each provider, status, reason and bound: few, whatever the number of requests.
    return rows.select((F.row_number().over(Window.orderBy("family", "k", "key")) - 1).alias("line_no"), "line")


def priority_sort(tasks: DataFrame) -> DataFrame:
    """tasks(path, size) with priority by size class, the most urgent first."""
    return tasks.withColumn("priority", F.when(F.col("size") > 1_000_000, 3).when(F.col("size") > 100_000, 2).otherwise(1)).orderBy(F.desc("priority"), "path")


def search_filter(rows: DataFrame, field: str, value: str, sort_by: str, descending: bool = False) -> DataFrame:
    """Rows whose field contains value in any case, sorted by a column."""
    kept = rows.where(F.contains(F.lower(F.col(field).cast("string")), F.lit(value.lower())))
    return kept.orderBy(F.desc(sort_by) if descending else F.asc(sort_by))


def reconciliation_diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(side, id): ids of a that b lacks and of b that a lacks, repeats kept."""
    left = a.select(key).join(b.select(key), key, "left_anti").select(F.lit("only_a").alias("side"), F.col(key).alias("id"))
    return left.unionByName(b.select(key).join(a.select(key), key, "left_anti").select(F.lit("only_b").alias("side"), F.col(key).alias("id")))
