"""A wiki on a file system: pages and entries written as Markdown files, compilation of PDF files, the index page.

Below `root` lie raw/ (what was extracted, and a prompt for each file that waits to be compiled), wiki/ (entries
and index.md; versions of entries in wiki/.versions) and _index/ (compile state, status, search index).
"""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import file_hash, format_text, parse_front_matter, source_name, to_markdown
from ..operators import compile_state as cs
from ..schema import COMPILE_STATE, ENTRY
from .files import extract_text, extract_whole, generate_index, read_markdown
from .tables import file_system, load, read_text, release, replace_file, save, spread, stage, write_text

#: The domain of what has none.
NO_DOMAIN = "未分类"


def write_files(files: DataFrame, root: str, dealt: bool = False) -> DataFrame:
    """Writes files(path, content string or binary) below root, a file for each row; returns staged (path, bytes).

    The rows are dealt to tasks by path, unless they lie in many tasks already.

    Executors write, through Arrow's file systems (file, hdfs, s3, gs), to a draft that is then renamed: a task
    that is run again writes the same file, and no reader sees half of one.  Null contents write empty files; rows
    with a null path or one that leaves root raise; of rows that repeat a path any may be written last.
    """

    def run(batches):
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        # A folder of the task's own: tasks that make files in one folder wait for one another there.
        drafts, made = f"{base}/.drafts-{uuid.uuid4().hex}", set()
        system.create_dir(drafts, recursive=True)
        try:
            for batch in batches:
                sizes = []
                for path, content in ((p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1))):
                    if path is None or path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"not a path below the root: {path}")
                    target, content = f"{base}/{path}", content or b""
                    folder = target.rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    draft = f"{drafts}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(draft) as out:
                        out.write(content)
                    system.move(draft, target)
                    sizes.append(len(content))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])
        finally:
            system.delete_dir(drafts)

    rows = files.select("path", F.col("content").cast("binary"))
    return stage((rows if dealt else spread(rows, "path")).mapInArrow(run, "path string, bytes long"), "written")


def _yaml(value: Column) -> Column:
    """A string as a YAML scalar: plain where that says the same, else in single quotes."""
    plain = F.regexp_like(value, F.lit(r"^[\p{L}/_][\p{L}\p{N} ./_-]*$")) & ~F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off", "y", "n") & ~F.endswith(value, F.lit(" "))
    return F.when(plain, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def raw_page(now: Column, quality: Column) -> Column:
    """The raw page of a row (path, text, page_count): front matter with the hash of the text, headings, and the formatted text."""
    name, stamp = source_name(F.col("path")), lambda pattern: F.date_format(now, pattern)
    score = F.regexp_replace(quality.cast("double").cast("string"), r"\.0$", ".0")
    head = [("source_file", _yaml(F.col("path"))), ("source_name", _yaml(name)), ("file_hash", _yaml(file_hash(F.col("text")))), ("extraction_time", stamp("yyyy-MM-dd'T'HH:mm:ss'Z'")), ("page_count", F.col("page_count").cast("string")), ("quality_score", score)]
    # The headings of a raw page.
    return F.concat(
        F.lit("---\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in head], F.lit("---\n\n# "), name, F.lit("\n\n## 文档信息\n\n- 页数: "), F.col("page_count").cast("string"),
        F.lit("\n- 质量: "), F.round(quality * 100).cast("int").cast("string"), F.lit("%\n- 提取时间: "), stamp("yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("\n\n## 正文\n\n"), format_text(F.col("text")),
    )


def texts_of(pages: DataFrame) -> DataFrame:
    """(path, text, page_count) of pages(path, page_number, text)."""
    return extract_text(pages, F.count("*").alias("page_count")).where("path is not null")


def save_raw(texts: DataFrame, root: str, now: Column, quality: float = 0.85) -> DataFrame:
    """Writes raw/<stem>.md for texts(path, text, page_count) and the index page; returns (source, path, page_count, bytes)."""
    pages = texts.select("path", F.concat(F.lit("raw/"), source_name(F.col("path")), F.lit(".md")).alias("file"), "page_count", raw_page(now, F.lit(quality)).alias("content"))
    written = write_files(pages.select(F.col("file").alias("path"), "content"), root)
    write_index(texts.sparkSession, root)
    return pages.select(F.col("path").alias("source"), F.col("file").alias("path"), "page_count").join(written.groupBy("path").agg(F.max("bytes").alias("bytes")), "path").select("source", "path", "page_count", "bytes")


def index_lines(index: DataFrame) -> DataFrame:
    """(domain, title, path, line) of generate_index's rows: a table row for each page."""
    return index.select("domain", "title", "path", F.concat(F.lit("| [["), "path", F.lit("]] | "), "abstract", F.lit(" |")).alias("line"))


def write_index(spark: SparkSession, root: str) -> int:
    """Writes wiki/index.md over the pages directly in wiki/, by domain and title; returns their number.

    The pages' rows pass through the driver one partition after another into the one file that they make.
    """
    fs, folder = file_system(spark, f"{root}/wiki")
    # Staged before they are sorted: a sort looks at its rows twice, and would open every file twice.
    lines = stage(index_lines(generate_index(read_markdown(spark, f"{root}/wiki"), ordered=False)), "index") if fs.exists(folder) else None
    rows = lines.orderBy("domain", "title", "path").toLocalIterator() if lines else []
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/wiki/.{uuid.uuid4().hex}")
    out, n, domain = fs.create(draft, True), 0, None
    put = lambda text: out.write(bytearray(text, "utf-8"))
    # The texts of the index page.
    put("# 知识索引\n\n> [!ABSTRACT] 摘要\n> 本页面是 Wiki 知识库的总导航图，按领域分类组织。\n\n")
    for r in rows:
        if r["domain"] != domain:
            domain = r["domain"]
            put(f"\n## [{domain}]\n\n| 词条 | 摘要 |\n|------|------|\n")
        put(r["line"] + "\n")
        n += 1
    if not n:
        put("*暂无词条。请使用 AI Agent 处理 raw/ 中的原始素材。*\n\n")
    put(f"\n---\n\n- **词条总数**: {n}\n- [[log.md]] - 编译日志\n")
    out.close()
    if lines:
        release(lines)
    replace_file(spark, draft, f"{root}/wiki/index.md")
    return n


def compile_prompt(now: Column) -> Column:
    """What an agent is given for a row (title, domain, source, page_count, source_hash, text): metadata, rules in short, and the text."""
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))
    # The headings and field names of a compile prompt.
    return F.concat(
        F.lit("# 知识编译任务\n\n## 文档元数据\n\n| 字段 | 值 |\n|------|-----|\n"), row("标题", F.col("title")), row("领域", F.col("domain")), row("来源", F.col("source")), row("页数", F.col("page_count").cast("string")),
        row("内容哈希", F.col("source_hash")), row("编译时间", F.date_format(now, "yyyy-MM-dd HH:mm:ss 'UTC'")),
        F.lit("\n## 编译指令\n\n- 10-15 concepts, each on its own page `wiki/"), F.replace(F.lower("domain"), F.lit(" "), F.lit("_")), F.lit("/["), F.col("domain"),
        F.lit("] <title>.md`; merge into pages that exist\n- front matter: "), F.lit(", ".join(ENTRY.names)), F.lit("\n- then update `wiki/index.md` and `wiki/log.md`\n\n---\n\n# 提取内容\n\n`raw/"), F.col("title"), F.lit(".md`\n\n"), F.col("text"), F.lit("\n"),
    )


def _page_names(files: DataFrame, state: DataFrame) -> DataFrame:
    """(path, title): the name of each file's page, which no other file's has."""
    known = state.select("path", F.nullif(F.regexp_extract(F.get("compiled_entries", F.lit(0)), r"^raw/(.*)\.compile_prompt\.md$", 1), F.lit("")).alias("known"))
    taken = known.where("known is not null").select(F.col("known").alias("stem"), F.lit(True).alias("taken")).distinct()
    named = files.distinct().withColumn("stem", source_name(F.col("path"))).join(known, "path", "left")
    fresh = named.where("known is null").join(taken, "stem", "left")
    first = fresh.groupBy("stem").agg(F.min("path").alias("first"))
    own = F.when((F.col("path") == F.col("first")) & F.col("taken").isNull(), F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.left(F.sha2("path", 256), F.lit(8))))
    return fresh.join(first, "stem").select("path", own.alias("title")).unionByName(named.where("known is not null").select("path", F.col("known").alias("title")))


_COMPILED = "source string, source_hash string, page_count long, raw_path string, prompt_path string, title string, domain string, level string, status string, version long, error string"


def compile_to_wiki(files: DataFrame, root: str, domain: str | None, now: Column, extractor: str = "text") -> DataFrame:
    """Compiles files(path, content): raw pages, prompts, and a level-0 pending entry for each; staged, everything is written.

    (source, source_hash, page_count, raw_path, prompt_path, title, domain, level, status, version, error).  The hash is
    of the file's bytes, as needs_compile takes it.  A file that cannot be extracted has an error and nothing is written
    for it.  A file keeps the page that the compile state has for it; a new one whose name without extension another has
    already, or another of this call before it by path, gets a page of its own with a part of its path's hash.
    """
    return _compiled(files, stage(_page_names(files.select("path"), load_state(files.sparkSession, root)), "names"), root, domain, now, extractor)


def _compiled(files: DataFrame, names: DataFrame, root: str, domain: str | None, now: Column, extractor: str) -> DataFrame:
    """compile_to_wiki of those files that staged names(path, title) has.

    Contents are sent once, to tasks that cut, hash and extract them; what is staged of them is the texts alone, and
    only until the pages and prompts are written, straight from there.
    """
    spark = files.sparkSession
    if names.isEmpty():
        write_index(spark, root)
        return stage(spark.createDataFrame([], _COMPILED), "results")
    # Names are hashed, so that contents are not sorted.
    due = spread(files.select("path", "content"), "path").join(names.hint("shuffle_hash"), "path")
    texts = stage(extract_whole(due, extractor), "texts", "zstd")
    raw_path, prompt_path = F.concat(F.lit("raw/"), F.col("title"), F.lit(".md")), F.concat(F.lit("raw/"), F.col("title"), F.lit(".compile_prompt.md"))
    good = texts.where("error is null and page_count > 0").withColumn("domain", F.lit(domain or NO_DOMAIN)).withColumn("source", raw_path)
    files_of = F.array(F.struct(F.col("source").alias("path"), raw_page(now, F.lit(0.0)).alias("content")), F.struct(prompt_path.alias("path"), compile_prompt(now).alias("content")))
    written = write_files(good.select(F.explode(files_of).alias("f")).select("f.*"), root, dealt=True)
    write_index(spark, root)
    done = good.select(
        F.col("path").alias("source"), "source_hash", "page_count", F.col("source").alias("raw_path"), prompt_path.alias("prompt_path"), "title", "domain", F.lit("l0").alias("level"), F.lit("pending").alias("status"), F.lit(1).cast("long").alias("version"), F.lit(None).cast("string").alias("error"),
    )
    bad = texts.where("error is not null").select(F.col("path").alias("source"), "source_hash", F.lit(0).cast("long").alias("page_count"), source_name(F.col("path")).alias("title"), "error")
    results = stage(done.unionByName(bad, allowMissingColumns=True), "results")
    release(texts, written, names)
    return results


def load_state(spark: SparkSession, root: str) -> DataFrame:
    """The compile state below root; an empty one if there is none."""
    return load(spark, f"{root}/_index/state", lambda: spark.createDataFrame([], COMPILE_STATE), ("path", "source_hash", "compiled_entries"))


def incremental_compile(files: DataFrame, root: str, now: Column, domain: str | None = None, extractor: str = "text", plan: DataFrame | None = None) -> DataFrame:
    """Compiles those of files(path, content) that are new, changed or compiled to nothing; (path, action, error) of all.

    What was compiled is recorded, and the status of the run is written: a second run over the same files skips
    them all.  A file that fails is neither compiled nor skipped, is not recorded, and does not end the run.  With a plan
    (path, action) that one is followed instead of one made from the state.
    """
    spark, began = files.sparkSession, time.time()
    state = load_state(spark, root)
    plan = stage(cs.incremental_plan(files, state), "plan") if plan is None else plan
    names = stage(_page_names(plan.where("action = 'compile' and path is not null").select("path"), state), "names")
    results = _compiled(files, names, root, domain, now, extractor)
    done = results.where("error is null")
    records = done.select(F.col("source").alias("path"), "source_hash", F.array("prompt_path").alias("compiled_entries"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_compiled"), F.lit(None).cast("string").alias("instruction_hash"), F.lit(None).cast("string").alias("model_id"))
    save(cs.record_compile(state, records), f"{root}/_index/state")
    outcome = stage(plan.join(results.select(F.col("source").alias("path"), "error"), "path", "left"), "outcome")
    release(results)
    totals = cs.incremental_totals(outcome).first()
    finished = spark.range(1).select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    cs.write_compile_status(spark, root, totals["compiled"], totals["skipped"], finished, int((time.time() - began) * 1000))
    return outcome


def write_entries(entries: DataFrame, root: str) -> DataFrame:
    """Writes entries(path, fields, body) as wiki/<path>; returns staged (path, bytes)."""
    return write_files(entries.select(F.concat(F.lit("wiki/"), "path").alias("path"), to_markdown(entries.columns).alias("content")), root)


def recompile_file(spark: SparkSession, root: str, path: str, now: Column) -> dict:
    """Marks wiki/<path> for recompiling: one version on, its source's hash anew, the old file kept in wiki/.versions.

    Returns path, version, title, domain, source_changed, source_exists and backup.  A missing file and one without
    valid front matter raise.
    """
    content = read_text(spark, f"{root}/wiki/{path}")
    if content is None:
        raise FileNotFoundError(f"{root}/wiki/{path}")
    one = spark.createDataFrame([(path, content)], "path string, content string")
    entry = one.select("path", parse_front_matter(F.col("content")).alias("e"), F.ltrim(F.element_at(F.split("content", "---"), 3)).alias("body")).where("e.title is not null").select("path", "e.*", "body")
    row = entry.first()
    if row is None:
        raise ValueError(f"no valid front matter in {path}")
    source = f"{root}/{row['source']}" if row["source"] else None
    fs, p = file_system(spark, source) if source else (None, None)
    exists = bool(source) and fs.exists(p)
    new_hash = spark.read.format("binaryFile").load(source).select(F.sha2("content", 256)).first()[0] if exists else None
    changed = exists and row["source_hash"] != new_hash
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    backup = f"wiki/.versions/{stem}_v{row['version']}.md"
    write_text(spark, f"{root}/{backup}", content)
    touched = entry.withColumn("version", F.col("version") + 1).withColumn("updated", now.cast("timestamp_ntz")).withColumn("status", F.lit("needs_recompile"))
    if changed:
        touched = touched.withColumn("source_hash", F.lit(new_hash))
    write_text(spark, f"{root}/wiki/{path}", touched.select(to_markdown(touched.columns)).first()[0])
    return {"path": path, "version": row["version"] + 1, "title": row["title"], "domain": row["domain"], "source_changed": changed, "source_exists": exists, "backup": backup}
