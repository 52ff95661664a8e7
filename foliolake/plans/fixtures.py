"""The synthetic tables seen as a knowledge base, in Spark and, as the same expressions, in SQL.

There are no PDFs, links or tags in them: documents stand for entries (links and tags follow from doc_id),
paragraphs of documents for pages, events for tool calls and metric samples, orders and line items for tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(c: str) -> str:
    return f"concat('e/', {c}, '.md')"


def entries(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """documents and labels as entries."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    none = "cast(array() as array<string>)"
    columns = [
        f"{_path('doc_id')} as path", "substring(split_part(text, '\\n', 1), 1, 60) as title", "lang as domain", "source as category",
        "array(source, concat('k', doc_id % 7), concat('m', doc_id % 11)) as tags",
        f"concat(if(doc_id % 3 = 0, array({_path('doc_id + 1')}), {none}), if(doc_id % 50 = 0, array(concat('e/missing-', doc_id, '.md')), {none})) as related",
        f"if(doc_id % 10 = 0, array({_path('doc_id - 1')}), {none}) as contradictions",
        "cast(coalesce(quality, 0) as double) as quality_score", "concat('l', doc_id % 4) as level",
        "element_at(array('pending', 'compiling', 'compiled', 'needs_recompile', 'failed'), cast(doc_id % 5 as int) + 1) as status", "1L as version",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id as int)) as created", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id as int)) as updated",
        "sha2(text, 256) as source_hash", "doc_id",
    ]
    return table(spark, sf_dir, "documents").join(quality, "doc_id", "left").selectExpr(*columns, *(["text as body"] if body else []))


ENTRIES = """WITH e AS (
  SELECT 'e/' || d.doc_id || '.md' AS path, substr(split_part(text, chr(10), 1), 1, 60) AS title, lang AS domain, source AS category,
    [source, 'k' || (d.doc_id % 7), 'm' || (d.doc_id % 11)] AS tags,
    list_concat(CASE WHEN d.doc_id % 3 = 0 THEN ['e/' || (d.doc_id + 1) || '.md'] ELSE [] END, CASE WHEN d.doc_id % 50 = 0 THEN ['e/missing-' || d.doc_id || '.md'] ELSE [] END) AS related,
    CASE WHEN d.doc_id % 10 = 0 THEN ['e/' || (d.doc_id - 1) || '.md'] ELSE [] END AS contradictions,
    coalesce(q.quality, 0)::DOUBLE AS quality_score, 'l' || (d.doc_id % 4) AS level, ['pending', 'compiling', 'compiled', 'needs_recompile', 'failed'][d.doc_id % 5 + 1] AS status,
    1::BIGINT AS version, TIMESTAMP '2024-01-01' + to_days(d.doc_id::INTEGER) AS created, sha256(text) AS source_hash, d.doc_id, text AS body
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id
), refs AS (
  SELECT path AS src, unnest(related) AS dst, 'related' AS kind FROM e UNION ALL SELECT path, unnest(contradictions), 'contradiction' FROM e
), links AS (
  SELECT r.src, r.dst, r.kind FROM refs r WHERE r.dst IN (SELECT path FROM e)
), tagged AS (
  SELECT path, unnest(list_distinct(tags)) AS tag, len(list_distinct(tags)) AS n FROM e
)
"""
TAG_PAIRS = """, tag_pairs AS (
  SELECT a.path AS a, b.path AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS jaccard FROM tagged a JOIN tagged b ON a.tag = b.tag AND a.path < b.path
  GROUP BY a.path, b.path, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.3
), edges AS (
  SELECT * FROM links UNION ALL SELECT a, b, 'tag_cooccurrence' FROM tag_pairs UNION ALL SELECT b, a, 'tag_cooccurrence' FROM tag_pairs
)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages."""
    lines = table(spark, sf_dir, "documents").select(F.expr(_path("doc_id")).alias("path"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    box = F.expr("struct(0d as x0, 0d as y0, 612d as x1, 792d as y1)")
    return lines.select("path", (F.col("k") + 1).alias("page_number"), "text", box.alias("bbox"), F.expr("cast(array() as array<struct<bbox:array<double>,text:string>>)").alias("lines"))


PAGES = """WITH p AS (
  SELECT path, k AS page_number, lines[k] AS text FROM (SELECT 'e/' || doc_id || '.md' AS path, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)
)
"""


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls: type is the tool, value the latency; a type `error` is a failure."""
    return table(spark, sf_dir, "events").selectExpr("ts", "event_id as key", "event_type as tool", "cast(floor(value) as bigint) as latency_ms", "event_type <> 'error' as success")


CALLS = "WITH c AS (SELECT ts, event_id AS key, event_type AS tool, floor(value)::BIGINT AS latency_ms, event_type <> 'error' AS success FROM events)\n"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tasks: status F completed, O pending, else processing; priority is the schema."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("completed_at"))
    status = "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'processing' end as status"
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr("o_orderkey as id", "o_orderpriority as schema_name", status, "o_orderdate as started_at", "completed_at")


TASKS = """WITH t AS (
  SELECT o_orderkey AS id, o_orderpriority AS schema_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderdate AS started_at, i.completed_at
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS completed_at FROM lineitem GROUP BY l_orderkey) i ON l_orderkey = o_orderkey
)
"""


def compile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of entries: every third is unknown, every fifth has changed, every seventh compiled to nothing."""
    return entries(spark, sf_dir).where("doc_id % 3 <> 0").selectExpr(
        "path", "if(doc_id % 5 = 0, sha2('old', 256), source_hash) as source_hash", "if(doc_id % 7 = 0, cast(array() as array<string>), array(path)) as compiled_entries",
        "cast(null as string) as last_compiled", "case doc_id % 4 when 0 then null when 1 then 'i1' else 'i2' end as instruction_hash", "cast(null as string) as model_id",
    )


STATE = """, s AS (
  SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256('old') ELSE source_hash END AS source_hash, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS n_compiled,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'i1' ELSE 'i2' END AS instruction_hash FROM e WHERE doc_id % 3 <> 0
)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{_path('doc_id')} as path", "cast(text as binary) as content")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files: every second one is given a PDF header, every third a font, every fifth an image."""
    return table(spark, sf_dir, "pages").selectExpr(
        "concat('/data/', page_id, if(page_id % 4 = 3, '.txt', '.pdf')) as path", "page_id",
        "cast(concat(if(page_id % 2 = 0, '%PDF-1.4 ', ''), if(page_id % 3 = 0, '/Font ', ''), if(page_id % 5 = 0, '/Image ', ''), html) as binary) as content",
    )


FILES = """WITH f AS (
  SELECT '/data/' || page_id || CASE WHEN page_id % 4 = 3 THEN '.txt' ELSE '.pdf' END AS path, page_id,
    CASE WHEN page_id % 2 = 0 THEN '%PDF-1.4 ' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '/Font ' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '/Image ' ELSE '' END || html AS content FROM pages
)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("concat('v/', vec_id) as path", "vec_id", "embedding as vector", "concat('vector ', vec_id) as title", "cast(label as string) as domain")
