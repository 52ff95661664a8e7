"""File sources and sinks: Markdown entries, binary files, JSON state and configuration, wiki pages."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import entry_body, file_size_mb, parse_front_matter, source_name
from ..schema import PAGE, RELATIONAL
from .tables import file_system, read_text, spread, stage, write_text

_SKIPPED = ("index.md", "log.md")


#: File systems that tasks open through Arrow, as they do to write; others are read by Spark's binaryFile.
_ARROW = ("file", "hdfs", "s3", "gs")
#: Names, files and bytes that a task holds before it hands them on.
NAMES_HELD, FILES_HELD, BYTES_HELD = 4096, 1024, 8 << 20


def _inside(uri: str, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder below uri, without hidden names; a local folder is read as a stream."""
    from pyarrow import fs as pafs

    system, base = pafs.FileSystem.from_uri(uri)
    at = f"{base}/{folder}" if folder else base
    hidden = lambda n: n.startswith(".") or n.startswith("_") and "=" not in n or n.endswith("._COPYING_")  # noqa: E731  as in Spark
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(at) as entries:
            yield from ((e.name, e.is_dir()) for e in entries if not hidden(e.name) and (not e.is_symlink() or os.path.exists(e.path)))
    else:
        found = system.get_file_info(pafs.FileSelector(at))
        yield from ((x.base_name, x.type == pafs.FileType.Directory) for x in found if not hidden(x.base_name))


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Staged (path): files below root whose names end so, relative to it; hidden ones and hidden folders are left out.

    Tasks list the folders, those of one depth side by side; no name passes through the driver.
    """

    def run(batches):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_()))], names=["path", "folder"])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for name, inner in _inside(root, folder):
                    if inner or name.endswith(suffix):
                        rows.append((f"{folder}/{name}" if folder else name, inner))
                    if len(rows) == NAMES_HELD:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        seen = stage(level.mapInArrow(run, "path string, folder boolean"), "listed")
        files, folders = seen.where("not folder").select("path"), seen.where("folder").select("path")
        found = files if found is None else found.unionByName(files)
        if not (n := folders.count()):
            return found
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def read_files(names: DataFrame, root: str) -> DataFrame:
    """(path, content as bytes) of files(path) below root: as many tasks as `spread` makes, however many files there are."""

    def run(batches):
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["path", "content"])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{path}") as file:
                    rows.append((path, file.read()))
                size += len(rows[-1][1])
                if len(rows) == FILES_HELD or size >= BYTES_HELD:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return spread(names, "path").mapInArrow(run, "path string, content binary")


def read_markdown(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """(path, content) of every *.md below root; hidden folders, where version backups lie, are not read.

    wanted is a condition on path: files that it leaves out are not opened.
    """
    fs, folder = file_system(spark, root)
    kept = ~F.substring_index("path", "/", -1).isin(*_SKIPPED) & (F.lit(True) if wanted is None else wanted)
    uri = fs.makeQualified(folder).toUri()
    if uri.getScheme() in _ARROW:
        if not fs.exists(folder):
            raise FileNotFoundError(root)
        # binaryFile lists on the driver, and makes a task for every 32 files, each opened by a Hadoop reader of its own.
        files = read_files(list_files(spark, uri.toString(), ".md").where(kept), uri.toString())
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        files = found.select(F.ltrim(F.replace("path", F.lit(root.rstrip("/")), F.lit("")), F.lit("/")).alias("path"), "content").where(kept)
    return files.select("path", F.col("content").cast("string").alias("content"))


def scan_entries(markdown: DataFrame, exact: bool = False) -> DataFrame:
    """Entries of markdown(path, content): front matter fields, path and body; what cannot be parsed is left out."""
    head = markdown.where(F.startswith(F.ltrim("content"), F.lit("---")))
    parsed = head.select("path", parse_front_matter(F.col("content")).alias("e"), entry_body(F.col("content"), exact).alias("body"))
    return parsed.where("e.title is not null").select("path", "e.*", "body")


def list_raw_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the folder's own *.pdf; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", False).load(folder).select("path", "length")


def scan_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_size, file_size_mb, content) of PDF files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF,Pdf}").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("file_size"), file_size_mb(F.col("length")).alias("file_size_mb"), "content")


def dir_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row (bytes): the sizes of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


#: Page extractors by name: bytes of a file to its pages' texts.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {
    "text": lambda raw: raw.decode("utf-8", "replace").split("\f"),
}


def register_extractor(name: str, pages: Callable[[bytes], list[str]]) -> None:
    EXTRACTORS[name] = pages


#: Pages, and characters of their texts, that a task holds before it hands them on.
PAGES_HELD, CHARS_HELD = 4096, 1 << 22


def _pages(pages_of: Callable[[bytes], list[str]]):
    """For mapInArrow: files (path, content) to (path, page_number, text, error), a few pages at a time."""
    types, names = [pa.string(), pa.int32(), pa.string(), pa.string()], ["path", "page_number", "text", "error"]

    def rows_of(path, raw):
        try:
            pages = pages_of(bytes(raw))
        except Exception as e:  # one bad file must not end the job: it is reported
            yield path, 0, None, str(e)
            return
        for k, text in enumerate(pages, 1):
            yield path, k, text.strip(), None

    def run(batches):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows, size = [], 0
            for path, raw in zip(batch.column(0), batch.column(1)):
                for row in rows_of(path.as_py(), raw.as_py()):
                    rows.append(row)
                    size += len(row[2] or "")
                    if len(rows) == PAGES_HELD or size >= CHARS_HELD:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def extract_structured(files: DataFrame, extractor: str = "text", width: float = 612.0, height: float = 792.0) -> DataFrame:
    """One row for each page of files(path, content), text trimmed; a file that fails has no pages and an error in `errors`."""
    raw = files.select("path", "content").mapInArrow(_pages(EXTRACTORS[extractor]), "path string, page_number int, text string, error string")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(width).alias("x1"), F.lit(height).alias("y1"))
    return raw.select("path", "page_number", "text", box.alias("bbox"), F.array().cast(PAGE.split("lines ")[1]).alias("lines"), "error")


def _whole_texts(pages_of: Callable[[bytes], list[str]]):
    """For mapInArrow: files (path, title, source_hash, content) to _WHOLE, a row for each file."""
    names, types = zip(*((c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _WHOLE.split(", ")))

    def row_of(path, title, digest, raw):
        try:
            pages = pages_of(bytes(raw))
        except Exception as e:  # one bad file must not end the job: it is reported
            return path, title, digest, None, 0, str(e)
        return path, title, digest, "\n".join(p.strip() for p in pages).strip(" "), len(pages), None

    def run(batches):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows, size = [], 0
            for file in zip(*batch.columns):
                rows.append(row_of(*(x.as_py() for x in file)))
                size += len(rows[-1][3] or "")
                if len(rows) == PAGES_HELD or size >= CHARS_HELD:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


_WHOLE = "path string, title string, source_hash string, text string, page_count long, error string"


def extract_whole(files: DataFrame, extractor: str = "text") -> DataFrame:
    """_WHOLE of files(path, title, content): extract_text of extract_structured's pages, made file by file, without a shuffle.

    A file that fails has an error and no text; source_hash is of its bytes.
    """
    return files.select("path", "title", F.sha2("content", 256).alias("source_hash"), "content").mapInArrow(_whole_texts(EXTRACTORS[extractor]), _WHOLE)


def batch_process(files: DataFrame, extractor: str = "text", report: Callable[[int, int, int], None] | None = None, parts: int = 10) -> DataFrame:
    """extract_structured in `parts` parts of the files, staged; report(done, failed, total) after each: counts of files.

    A part is written before the next begins, so a run that stops keeps what it reported.  Empty table: no rows.
    """
    total, done, failed, out = files.count(), 0, 0, None
    for k in range(parts):
        part = files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k)
        pages = stage(extract_structured(part, extractor), "batch")
        counts = pages.agg(F.countDistinct("path").alias("n"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("path"))).alias("bad")).first()
        done, failed = done + counts["n"], failed + counts["bad"]
        if report:
            report(done, failed, total)
        out = pages if out is None else out.unionByName(pages)
    return out


def extract_text(pages: DataFrame, *more: Column) -> DataFrame:
    """(path, text): pages in order, a line break between, trimmed; and what `more` aggregates over a path's pages."""
    in_order = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    held = pages.groupBy("path").agg(in_order.alias("p"), *more)
    return held.select("path", F.trim(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("text"), *held.columns[2:])


def get_page_count(pages: DataFrame) -> DataFrame:
    """(path, page_count): rows of each path; a path without pages has no row."""
    return pages.groupBy("path").agg(F.count("*").alias("page_count"))


def page_fill(pages: DataFrame) -> DataFrame:
    """(path, filled, pages, share): pages that hold any text, all pages, and the share in percent; null is no text."""
    counted = pages.groupBy("path").agg(F.count_if(F.coalesce("text", F.lit("")) != "").alias("filled"), F.count("*").alias("pages"))
    return counted.withColumn("share", 100.0 * F.col("filled") / F.col("pages"))


def strip_tags(html) -> object:
    """Text of an HTML string: scripts and styles dropped, tags to blanks, common entities undone, blanks folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.regexp_replace(bare, name, sign)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


# ---- sinks ----------------------------------------------------------------------------------------

def agent_payload(texts: DataFrame) -> DataFrame:
    """(path, payload): `# name`, a blank line, and the content."""
    return texts.select("path", F.concat(F.lit("# "), source_name(F.col("path")), F.lit("\n\n"), F.col("text")).alias("payload"))


def generate_index(pages: DataFrame, ordered: bool = True) -> DataFrame:
    """(domain, title, path, abstract) of pages(path, content) directly in the wiki, by domain and title unless ordered is False.

    Title: the first `# ` line, else the file's name; `[domain] name` is split, and a title that only opens the
    bracket leaves the page out; abstract: the line after the one that holds `[!ABSTRACT]`, trimmed.
    """
    top = pages.where(~F.contains("path", F.lit("/")) & ~F.col("path").isin(*_SKIPPED))
    heading = F.regexp_extract("content", r"(?m)^# (.*)$", 1)
    title = F.when(F.regexp_like("content", F.lit(r"(?m)^# ")), heading).otherwise(F.replace("path", F.lit(".md"), F.lit("")))
    rows = top.select("path", title.alias("title"), F.trim(F.regexp_extract("content", r"\[!ABSTRACT\][^\n]*\n([^\n]*)", 1)).alias("abstract"))
    rows = rows.where(~F.startswith("title", F.lit("[")) | F.contains("title", F.lit("]")))
    named = F.startswith("title", F.lit("["))
    close = F.locate("]", F.col("title"))
    # Fixed value: the domain of a page that names none.
    domain = F.when(named, F.substr(F.col("title"), F.lit(2), close - 2)).otherwise("未分类")
    name = F.when(named, F.substr(F.col("title"), close + 2)).otherwise(F.col("title"))
    index = rows.select(domain.alias("domain"), name.alias("title"), "path", "abstract")
    return index.orderBy("domain", "title", "path") if ordered else index


# ---- configuration --------------------------------------------------------------------------------

def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """The configuration at path; none: empty."""
    text = read_text(spark, path)
    return {str(k): str(v) for k, v in json.loads(text).items()} if text else {}


def set_config(spark: SparkSession, path: str, changes: dict[str, str | None]) -> dict[str, str]:
    """Sets keys (None removes one) and replaces the file in one step; returns what holds now."""
    new = {**read_config(spark, path), **{k: v for k, v in changes.items() if v is not None}}
    for k, v in changes.items():
        if v is None:
            new.pop(k, None)
    write_text(spark, path, json.dumps(new, sort_keys=True, ensure_ascii=False))
    return new


def config_show(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """(key, value) by key; an empty configuration has no rows."""
    return spark.createDataFrame(sorted(config.items()), "key string, value string").orderBy("key")


def create_relational_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """The relational tables as managed Parquet tables."""
    names = []
    for name, columns in RELATIONAL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")
        names.append(prefix + name)
    return names
