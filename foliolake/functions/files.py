"""Expressions over files and front matter: hashes, probes, validation, names, page ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENTRY, LEVELS, STATUSES

MAX_BYTES = 100 * 1024 * 1024


def file_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, in lower-case hex."""
    return F.sha2(content, 256)


def file_size_mb(size: Column) -> Column:
    return F.round(size.cast("double") / 1048576, 2)


def source_name(path: Column) -> Column:
    """The file's stem, or "unknown"."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return F.when(stem == "", "unknown").otherwise(F.coalesce(stem, F.lit("unknown")))


def format_text(text: Column) -> Column:
    """Lines that are not blank, five to a paragraph."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    groups = F.ceil(F.size(lines) / 5).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(groups, F.lit(1))), lambda k: F.array_join(F.slice(lines, (k - 1) * 5 + 1, 5), "\n"))
    return F.when(F.size(lines) > 0, F.array_join(parts, "\n\n")).otherwise("")


# ---- probes ---------------------------------------------------------------------------------------

def printable_density(content: Column) -> Column:
    """Share of printable ASCII and white space in the first 2048 bytes; nothing: 0."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    kept = F.length(F.regexp_replace(head, r"[^\x20-\x7e\t\n\f\r]", ""))
    return F.when(F.length(head) > 0, kept / F.length(head)).otherwise(0.0)


def determine_quality(density: Column, fonts: Column, images: Column) -> Column:
    """The order of the rules matters."""
    return F.when(~fonts & images, "scanned").when((density < 0.1) & images, "low_quality").when(fonts, "digital").otherwise("unknown")


def probe_confidence(density: Column, fonts: Column, images: Column) -> Column:
    return F.when(fonts & (density > 0.3), 0.95).when(images & ~fonts, 0.90).otherwise(0.70)


# Marks of fonts and of images in a file's first bytes, and how pages of each quality are read.
FONT_MARKS = ("/Font", "/Type0", "/CIDFont")
IMAGE_MARKS = ("/Image", "/XObject", "/DCTDecode", "/FlateDecode")
METHODS = {"scanned": "vlm", "low_quality": "hybrid"}


def quality_probe(files: DataFrame) -> DataFrame:
    """(path, density, has_fonts, has_images, quality, confidence, needs_vlm, extraction_method) of files(path, content).

    A file that does not begin as a PDF, null among them, is invalid: density 0, confidence 1.
    """
    head = F.decode(F.substring("content", 1, 2048), "ISO-8859-1")
    valid = F.coalesce(F.startswith("head", F.lit("%PDF")), F.lit(False))
    p = files.select("path", head.alias("head"), printable_density(F.col("content")).alias("density")).withColumn("valid", valid)
    marked = lambda marks: F.col("valid") & F.regexp_like("head", F.lit("|".join(marks)))
    p = p.withColumn("has_fonts", marked(FONT_MARKS)).withColumn("has_images", marked(IMAGE_MARKS)).withColumn("density", F.when(F.col("valid"), F.col("density")).otherwise(0.0))
    quality = F.when(~F.col("valid"), "invalid").otherwise(determine_quality(F.col("density"), F.col("has_fonts"), F.col("has_images")))
    confidence = F.when(~F.col("valid"), 1.0).otherwise(probe_confidence(F.col("density"), F.col("has_fonts"), F.col("has_images")))
    p = p.withColumn("quality", quality).withColumn("confidence", confidence)
    method = F.coalesce(F.create_map(*[F.lit(v) for kv in METHODS.items() for v in kv])[F.col("quality")], F.lit("pdfium"))
    return p.select("path", "density", "has_fonts", "has_images", "quality", "confidence", F.col("quality").isin(*METHODS).alias("needs_vlm"), method.alias("extraction_method"))


def probe_density_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(path, density, quality) over the first three pages: characters for each 1000 units of area, a tenth, at most 1."""
    head = pages.where("page_number <= 3").groupBy("path").agg(F.sum(F.length("text")).alias("chars"), F.sum((F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))).alias("area"))
    density = F.when(F.col("area") > 0, F.least(F.col("chars") / (F.col("area") / 1000) / 10, F.lit(1.0))).otherwise(0.0)
    d = head.select("path", density.alias("density")).join(images, "path", "left")
    return d.select("path", "density", F.when((F.col("density") < 0.05) & F.coalesce("has_images", F.lit(False)), "scanned").otherwise("digital").alias("quality"))


# ---- validation -----------------------------------------------------------------------------------

def validate_file(most: int = MAX_BYTES) -> Column:
    """error_code of candidate(path, exists, length, header), null if it is fine."""
    return (
        F.when(~F.col("exists"), "not_found")
        .when(~F.endswith(F.lower("path"), F.lit(".pdf")), "bad_extension")
        .when(F.col("length") > most, "too_large")
        .when(F.col("length") == 0, "empty")
        .when(~F.coalesce(F.startswith(F.decode(F.substring("header", 1, 4), "ISO-8859-1"), F.lit("%PDF")), F.lit(False)), "bad_magic")
    )


def validate_path_safety(path: Column, base_dir: str) -> Column:
    base = base_dir.rstrip("/") + "/"
    return (
        F.when(F.contains(path, F.lit("..")), "traversal")
        .when(~F.startswith(path, F.lit("/")), "not_absolute")
        .when(~F.endswith(F.lower(path), F.lit(".pdf")), "bad_extension")
        .when(~F.startswith(path, F.lit(base)), "outside_base")
    )


def validate_upload(filename: Column, length: Column, most: int = MAX_BYTES) -> Column:
    return F.when(F.trim(F.coalesce(filename, F.lit(""))) == "", "no_name").when(~F.endswith(F.lower(filename), F.lit(".pdf")), "bad_extension").when(length > most, "too_large").when(length == 0, "empty")


# ---- front matter ---------------------------------------------------------------------------------

def entry_body(content: Column, exact: bool = False) -> Column:
    """What follows the front matter; exact: only as far as the next `---`."""
    whole = F.regexp_replace(content, r"(?s)^\s*---.*?\n---[ \t]*\r?\n?", "")
    return F.element_at(F.split(content, "---"), 3) if exact else whole


def parse_front_matter(content: Column) -> Column:
    """The entry's fields as a struct; null without valid front matter or without title, domain or dates.

    Unknown keys are ignored, missing optional ones defaulted; levels in any case and plain dates are read.
    """
    # Only what stands before the second mark goes to Python; nothing, if there is none.
    end = F.position(F.lit("---"), content, F.position(F.lit("---"), content) + 3)
    return _parsed(F.substr(content, F.lit(1), F.when(end > 0, end + 2).otherwise(0)))


def _parsed_(content: pd.Series) -> pd.DataFrame:
    rows = [_fields(c) for c in content]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in ENTRY.names})


# Declared as not deterministic so that a filter on a field is not moved below it, where texts would be parsed twice.
_parsed = F.pandas_udf(_parsed_, ENTRY).asNondeterministic()


def _fields(content: str | None) -> dict:
    import datetime as dt

    import yaml

    def when(v):
        if isinstance(v, str):
            v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
        if isinstance(v, dt.datetime):
            return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        return dt.datetime(v.year, v.month, v.day)

    text = (content or "").lstrip()
    parts = text.split("---", 2) if text.startswith("---") else []
    if len(parts) < 3:
        return {}
    try:
        raw = yaml.load(parts[1], getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # safe as well, in C where libyaml is there
        names = lambda k: [str(x) for x in raw.get(k) or []]
        level, status = str(raw.get("level") or "l1").lower(), str(raw.get("status") or "pending").lower()
        if level not in LEVELS or status not in STATUSES:
            return {}
        text_ = lambda k: None if raw.get(k) is None else str(raw[k])
        return {
            "title": str(raw["title"]), "domain": str(raw["domain"]), "category": text_("category"), "source": text_("source"), "page": None if raw.get("page") is None else int(raw["page"]),
            "source_hash": text_("source_hash"), "tags": names("tags"), "level": level, "contradictions": names("contradictions"), "related": names("related"), "aggregated_from": names("aggregated_from"),
            "quality_score": float(raw.get("quality_score") or 0), "status": status, "version": int(raw.get("version") or 0), "created": when(raw["created"]), "updated": when(raw["updated"]),
        }
    except (yaml.YAMLError, KeyError, TypeError, ValueError, AttributeError):
        return {}


def to_markdown(columns: list[str] | None = None) -> Column:
    """An entry's row as Markdown with front matter: every field that parse_front_matter reads, so nothing is lost.

    Optional fields that are null (category, source, page, source_hash) or empty (aggregated_from) are left out.
    `columns` names the columns the row has, by default all fields; those it lacks count as null.
    """
    have = set(ENTRY.names) if columns is None else set(columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast(ENTRY[c].dataType)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(col(c), F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    names = lambda c: F.when(F.coalesce(F.size(col(c)), F.lit(0)) > 0, F.to_json(col(c))).otherwise("[]")
    stamp = lambda c: F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = lambda c, v: F.concat(F.lit(f"{c}: "), v, F.lit("\n"))
    if_any = lambda c, v: F.coalesce(F.when(col(c).isNotNull(), line(c, v)), F.lit(""))
    return F.concat(
        F.lit("---\n"), line("title", quoted("title")), line("domain", quoted("domain")), if_any("category", quoted("category")), if_any("source", quoted("source")), if_any("page", col("page").cast("string")),
        if_any("source_hash", quoted("source_hash")), line("tags", names("tags")), line("level", F.coalesce(col("level"), F.lit("l1"))), line("contradictions", names("contradictions")), line("related", names("related")),
        F.when(F.coalesce(F.size(col("aggregated_from")), F.lit(0)) > 0, line("aggregated_from", names("aggregated_from"))).otherwise(""),
        line("quality_score", F.coalesce(col("quality_score"), F.lit(0.0)).cast("string")), line("status", F.coalesce(col("status"), F.lit("pending"))), line("version", F.coalesce(col("version"), F.lit(0)).cast("string")),
        line("created", F.coalesce(stamp("created"), F.lit(""))), line("updated", F.coalesce(stamp("updated"), F.lit(""))), F.lit("---\n"), F.coalesce("body", F.lit("")),
    )


def touch(entries: DataFrame, now: Column) -> DataFrame:
    """entries one version on, updated now; a null version stays null."""
    return entries.withColumn("version", F.col("version") + 1).withColumn("updated", now)


# ---- page ranges ----------------------------------------------------------------------------------

def parse_page_range(spec: Column, most: Column) -> Column:
    """`1-5,7` as sorted distinct pages; ends are clamped to most, bad parts and reversed ranges give none."""
    part = F.transform(F.split(spec, ","), lambda p: F.trim(p))

    def pages(p: Column) -> Column:
        low, high = (F.regexp_extract(p, r"^(\d{1,9})\s*(?:-\s*(\d{1,9}))?$", k) for k in (1, 2))
        a = F.when(low != "", low).cast("int")
        b = F.least(F.when(high != "", high).otherwise(low).try_cast("int"), most)
        # A single page stands as it is if it exists; sequence would count down, so reversed ranges are caught.
        return F.when(a.isNotNull() & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(part, pages)))), F.array().cast("array<int>"))


def micro_compile(pages: DataFrame, spec: str | None = None) -> DataFrame:
    """(path, content): pages, all or those of the range, as `## Page n` sections in order."""
    kept = pages
    if spec:
        most = pages.groupBy("path").agg(F.max("page_number").alias("most"))
        kept = pages.join(most, "path").where(F.array_contains(parse_page_range(F.lit(spec), F.col("most")), F.col("page_number")))
    section = F.concat(F.lit("## Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.trim("text"))
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("content"))
