"""Quality checks of entries: issues, totals, drift, contradictions, health."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .graph import broken_links, graph_counts, references, resolve_links

#: Entries of a tag that lie in one tile on average, what is sent for a pair of them falls as this grows; rows compared at once.
TILE, ROWS_COMPARED = 4096, 256
MISSING = lambda c: F.coalesce(F.col(c), F.lit("")) == ""


def has_minimal_quality() -> Column:
    """Title, domain and tags are all there; a title of blanks is one."""
    return ~MISSING("title") & ~MISSING("domain") & (F.coalesce(F.size("tags"), F.lit(0)) > 0)


def check_quality(entries: DataFrame) -> DataFrame:
    """(path, severity, message): one row for each rule an entry breaks, in one scan; null is empty, and no score is 0."""
    issue = lambda when, severity, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    rules = F.array(
        issue(MISSING("title"), "error", "Missing title"),
        issue(MISSING("domain"), "error", "Missing domain"),
        issue(F.coalesce(F.size("tags"), F.lit(0)) <= 0, "warning", "No tags assigned"),
        issue(F.coalesce(F.col("quality_score"), F.lit(0.0)) == 0, "info", "Quality score is 0 (not yet assessed)"),
    )
    return entries.select("path", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("i")).select("path", "i.severity", "i.message")


def quality_totals(entries: DataFrame) -> DataFrame:
    """One row: total_entries, domains, average_score over scores above 0 (0 if there are none)."""
    score = F.col("quality_score").cast("double")
    return entries.agg(F.count("*").alias("total_entries"), F.countDistinct("domain").alias("domains"), F.coalesce(F.avg(F.when(score > 0, score)), F.lit(0.0)).alias("average_score"))


def quality_flags(issues: DataFrame) -> DataFrame:
    """One row: has_errors, has_warnings."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("severity") == s), F.lit(False))
    return issues.agg(any_("error").alias("has_errors"), any_("warning").alias("has_warnings"))


def entry_relative_path() -> Column:
    """`domain/[Domain] Title.md`, as it follows from title and domain."""
    clean = lambda c: F.regexp_replace(c, r'[/\\:*?"<>|]', "_")
    folder = F.regexp_replace(F.lower("domain"), " ", "_")
    return F.concat(folder, F.lit("/"), entry_filename(clean))


def entry_filename(clean=lambda c: F.regexp_replace(c, r'[/\\:*?"<>|]', "_")) -> Column:
    return F.concat(F.lit("["), F.col("domain"), F.lit("] "), clean(F.col("title")), F.lit(".md"))


def quality_orphans(entries: DataFrame) -> DataFrame:
    """Entries above level 0 that mention nothing and whose computed path is no `related` target.

    Contradiction targets do not count, and the key is the path that title and domain give, not the file's.
    """
    targets = references(entries, exact=True).where("kind = 'related'").select(F.col("dst").alias("relative_path"))
    alone = entries.where((F.lower("level") != "l0") & (F.coalesce(F.size("related"), F.lit(0)) <= 0) & (F.coalesce(F.size("contradictions"), F.lit(0)) <= 0))
    return alone.select("path", entry_relative_path().alias("relative_path")).join(targets, "relative_path", "left_anti").select("path", "relative_path")


def hypothesis_test(entries: DataFrame) -> DataFrame:
    """(path_a, path_b, title_a, title_b): contradicting pairs, each once; title_b is "" if b cannot be read."""
    named = references(entries).where("kind = 'contradiction'").select(F.least("src", "dst").alias("path_a"), F.greatest("src", "dst").alias("path_b")).distinct()
    titles = entries.select("path", "title")
    out = named.join(titles.select(F.col("path").alias("path_a"), F.col("title").alias("title_a")), "path_a", "left").join(titles.select(F.col("path").alias("path_b"), F.col("title").alias("title_b")), "path_b", "left")
    return out.select("path_a", "path_b", F.coalesce("title_a", F.lit("")).alias("title_a"), F.coalesce("title_b", F.lit("")).alias("title_b"))


_DRIFT = "path_a string, path_b string, shared_tag string, days_apart long, similarity double"


def drift_pairs(entries: DataFrame, vectors: DataFrame, most_similar: float = 0.6, days: int = 90, ordered: bool = True) -> DataFrame:
    """(path_a, path_b, shared_tag, days_apart, similarity) of entries that share a tag but have grown apart.

    Created at least `days` whole days apart, cosine under most_similar; each pair once, under its least shared tag; least
    similar first, or, not ordered, without the sort of all pairs.  Entries without a vector, a time or a tag are in no pair; vectors of unequal lengths, of length 0 or with
    null components have similarity 0.  A tag's entries lie in tiles of some TILE: two tiles meet in one row, whose cosines
    are one matrix product.  The pairs of a tag that most entries share grow with their square: that is the result, and
    no task holds a whole tag.
    """
    kind = "array<float>" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"  # as wide as they are: tiles are sent
    numbers = F.when(F.exists("vector", lambda x: x.isNull()), F.array().cast(kind)).otherwise(F.col("vector").cast(kind))
    own = entries.select("path", F.unix_timestamp(F.col("created").cast("timestamp")).alias("at"), F.array_sort(F.array_distinct("tags")).alias("tags")).where("at is not null").join(vectors.select("path", numbers.alias("vector")), "path")
    keyed = own.select("path", "at", "tags", "vector", F.explode("tags").alias("tag")).where("tag is not null")
    counts = keyed.groupBy("tag").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = keyed.join(counts, "tag").withColumn("tile", F.pmod(F.xxhash64("path"), F.col("tiles")).cast("int"))
    tiles = stage(dealt.groupBy("tag", "tiles", "tile").agg(F.collect_list(F.struct("path", "at", "tags", "vector")).alias("rows")), "tiles")
    left = tiles.select("tag", "tile", F.col("rows").alias("a"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"))
    # Tiles are few and their pairs many: they are spread out before they meet.
    left = left.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tag", "other")
    met = left.join(tiles.select("tag", F.col("tile").alias("other"), F.col("rows").alias("b")), ["tag", "other"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tag, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() == batch.column(2)[k].as_py()
                yield from _drifted(tag, batch.column(3)[k].values, batch.column(4)[k].values, same, most_similar, days)

    out = met.select("tag", "tile", "other", "a", "b").mapInArrow(run, _DRIFT)
    return out.orderBy("similarity", "path_a", "path_b") if ordered else out


def _drifted(tag: str, a: pa.StructArray, b: pa.StructArray, same: bool, most_similar: float, days: int) -> Iterator[pa.RecordBatch]:
    """The pairs of two tiles of a tag; of one tile with itself each pair once."""
    sides = []
    for rows in (a, b):
        width = rows.field("vector")
        long = np.diff(np.asarray(width.offsets))
        flat, matrix = np.asarray(width.flatten()), np.zeros((len(rows), int(long.max(initial=0))))
        matrix[np.arange(matrix.shape[1]) < long[:, None]] = flat
        sides.append((rows.field("path"), np.asarray(rows.field("at")), rows.field("tags").to_pylist(), long, matrix))
    (path_a, at_a, tags_a, long_a, x), (path_b, at_b, tags_b, long_b, y) = sides
    wide = min(x.shape[1], y.shape[1])
    norm_a, norm_b = (np.sqrt((z * z).sum(1)) for z in (x, y))
    # A pair belongs to its least shared tag: those that share a lesser one come under that.
    lesser = {t: k for k, t in enumerate({t for tags in tags_a for t in tags if t is not None and t < tag})}
    has = [np.zeros((len(tags), len(lesser)), np.float32) for tags in (tags_a, tags_b)]
    for out, tags in zip(has, (tags_a, tags_b)):
        for k, own in enumerate(tags):
            out[k, [lesser[t] for t in own if t in lesser]] = 1
    for start in range(0, len(x), ROWS_COMPARED):
        own = slice(start, start + ROWS_COMPARED)
        with np.errstate(all="ignore"):
            norms = norm_a[own, None] * norm_b
            cosine = np.clip((x[own, :wide] @ y[:, :wide].T) / norms, -1.0, 1.0)
        cosine = np.where((long_a[own, None] == long_b) & ~(norms <= 0), np.where(np.isnan(cosine), 1.0, cosine), 0.0)
        keep = (cosine < most_similar) & (np.abs(at_a[own, None] - at_b) >= days * 86400)
        if same:
            keep &= np.arange(start, start + len(keep))[:, None] < np.arange(len(y))
        if lesser:
            keep &= has[0][own] @ has[1].T == 0
        i, j = np.nonzero(keep)
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            first, second = path_a.take(pa.array(p + start)), path_b.take(pa.array(q))
            turned, equal = pc.greater(first, second), pc.equal(first, second)
            columns = [pc.if_else(turned, second, first), pc.if_else(turned, first, second), pa.repeat(tag, len(p)), pa.array(np.abs(at_a[p + start] - at_b[q]) // 86400), pa.array(cosine[p, q])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DRIFT.split(", ")]).filter(pc.invert(equal))


def get_health_report(entries: DataFrame, edges: DataFrame | None, issues: DataFrame, orphans: DataFrame, index_bytes: int = 0, last_compile: str | None = None) -> DataFrame:
    """One row of one-row totals; without edges those of the entries' graph are counted and not made."""
    return (
        quality_totals(entries)
        .crossJoin(graph_counts(entries, edges).select("edge_count"))
        .crossJoin(issues.agg(F.count("*").alias("issues_count"), F.count_if(F.contains("message", F.lit("contradiction"))).alias("contradiction_count")))
        .crossJoin(orphans.agg(F.count("*").alias("orphan_count")))
        .crossJoin(broken_links(entries).agg(F.count("*").alias("broken_link_count")))
        .withColumn("node_count", F.col("total_entries"))
        .withColumn("index_bytes", F.lit(index_bytes).cast("long"))
        .withColumn("last_compile", F.lit(last_compile).cast("string"))
    )


def quality_report_lines(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """(severity_rank, path, message, line): a line of the report for every issue, errors first, then by path and message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.select(rank.alias("severity_rank"), "path", "message", F.format_string("- [%s] %s: %s", "severity", "path", "message").alias("line")).orderBy("severity_rank", "path", "message")


def quality_report_markdown(entries: DataFrame, issues: DataFrame) -> str:
    """The report as one text: totals, and every issue by severity and path; for more than a text may hold see quality_report_lines."""
    t = quality_totals(entries).first()
    counts = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    lines = ["# Quality report", "", f"- entries: {t['total_entries']}", f"- domains: {t['domains']}", f"- average score: {t['average_score']:.2f}", ""]
    lines += [f"- {s}: {counts.get(s, 0)}" for s in ("error", "warning", "info")] + [""]
    lines += [r["line"] for r in quality_report_lines(entries, issues).toLocalIterator()]
    return "\n".join(lines) + "\n"


def quality_bands(entries: DataFrame) -> DataFrame:
    """(band, n): scores from 0.9, 0.7, 0.5, and below."""
    s = F.col("quality_score").cast("double")
    band = F.when(s >= 0.9, "excellent").when(s >= 0.7, "good").when(s >= 0.5, "fair").otherwise("poor")
    return entries.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def by_category_and_status(entries: DataFrame, categories: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Entries of some categories and states, written in any case; None asks for all, an empty list for none; null is in no list."""
    kept = entries
    for column, values in (("category", categories), ("status", statuses)):
        if values is not None:
            kept = kept.where(F.lower(column).isin([v.lower() for v in values]) if values else F.lit(False))
    return kept


def link_totals(entries: DataFrame) -> DataFrame:
    """(kind, links): resolved mentions by kind."""
    return resolve_links(entries).groupBy("kind").agg(F.count("*").alias("links"))


def index_size_mb(size: float) -> float:
    return math.floor(size / 1048576 * 100 + 0.5) / 100
