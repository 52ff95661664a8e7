"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared among its documents in proportion to a preference, by default the binary digits
of their sizes, so that a longer text is likelier than a shorter one; no share exceeds the most copies of a
document, and what is cut off there goes to the others.  Whole copies of a share are certain; for the
fraction that remains, which differs from document to document, documents are ranked by random odds over
inclusion odds (Rosen's Pareto sampling), and the sample is the head of that order whose words fit what is
still wanted, closed by up to CLOSING further documents, each the one that comes nearest to the rest.

No source is sorted: the end of the head is found by histograms of the rank, refined twice, so a source
that holds a third of all rows is only ever counted.  A document's random number comes from its own id and
text: what is drawn depends neither on partitioning nor on when it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

MOST_COPIES = 3
CLOSING = 3
_BINS = 1024
_NONE = (1 << 63) - 1


def _size(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of sources(source, source_size): water filling.

    Sources by code point, null last, weigh `weights` in turn and share all sizes; none gets more than
    `most` times its own size, and what it leaves is shared by weight among the rest.  One sort of one row a
    source: their number, not their rows, is what a task must bear.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weigh).withColumn("most", F.col("source_size").cast("double") * most)
    every = Window.partitionBy()
    fullest = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fullest), F.lit(0.0))
    level = (F.sum("source_size").over(every).cast("double") - before("most")) / (F.sum("weight").over(every) - before("weight"))
    s = s.withColumn("full", F.col("most") < level * F.col("weight"))
    rest = F.sum("source_size").over(every).cast("double") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * (rest / open_)).alias("target"))


def _random(seed: int) -> Column:
    """Uniform in (0, 1), from the row's doc_id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _drawn(docs: DataFrame, seed: int, preference: str | None) -> list[Column]:
    """doc_id, id, source, size, prefer and u of each row of docs."""
    size = _size(F.col("text").cast("string"))
    if preference is None:
        prefer = F.length(F.bin(size)).cast("double")
    else:  # three digits, so that a source has a bounded number of different ones
        given = F.greatest(F.coalesce(F.col(f"`{preference}`").cast("double"), F.lit(1.0)), F.lit(0.0))
        unit = F.pow(F.lit(10.0), F.floor(F.log10(given)) - 2)
        prefer = F.when(given > 0, F.round(given / unit) * unit).otherwise(0.0)
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_NONE)).alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"), prefer.alias("prefer"), _random(seed).alias("u")]


def _beside(df: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """df with its source's row of `of`, a staged table of one row a source."""
    return df.join(of.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def levels(classes: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """aims(source, ..., target) with level: a document's expected copies are least(level * prefer, most).

    classes(source, prefer, words) holds the words of each preference, a bounded number for a source.  The
    level is that of the largest preference which, with all larger ones at the cap, stays below it; where none
    does, all that is preferred is capped and the level is infinite.
    """
    by_prefer = Window.partitionBy("source").orderBy(F.desc("prefer"))
    inside = F.coalesce(F.sum("words").over(by_prefer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    open_ = F.sum(F.col("words") * F.col("prefer")).over(by_prefer.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = _beside(classes.where("prefer > 0"), aims.select("source", "target"))
    tried = placed.select("source", "prefer", ((F.col("target") - most * inside) / F.when(open_ > 0, open_)).alias("level"))
    found = tried.where(F.col("level") * F.col("prefer") < most).groupBy("source").agg(F.max_by("level", "prefer").alias("level"))
    return _beside(aims, found, "left").withColumn("level", F.coalesce("level", F.lit(float("inf"))))


def _ranked(df: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """df with its certain copies, and its rank in (0, 1): Pareto's ratio of odds, as a share."""
    wanted = F.when(F.col("prefer") > 0, F.least(F.col("level") * F.col("prefer"), F.lit(float(most)))).otherwise(0.0)
    wanted = F.when(F.col("target") > 0, wanted).otherwise(0.0)
    certain = F.floor(wanted).cast("long")
    fraction = F.col("wanted") - F.col("certain")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - fraction) / fraction)
    placed = _beside(df, aims, "left").withColumn("wanted", wanted).withColumn("certain", certain)
    return placed.withColumn("rank", F.when(fraction > 0, odds / (1 + odds)))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, preference: str | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) that the mix takes, each as often as it takes them.

    Columns and their names are those of docs.  See `allocation` for what is taken.
    """
    plan = allocation_plan(docs, seed, weights, most, preference)[1]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    chosen = _decided(_ranked(docs.select(whole.alias("whole"), *_drawn(docs, seed, preference)), plan, most)).where("copies > 0")
    times = chosen.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*[F.col(f"whole.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def allocation(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, preference: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of docs(doc_id, text, source, ...).

    size is the row's number of words (null text: 0), source_size its source's, target the words its source
    should give, copies (0 to `most`) how often the mix takes the row.  `preference` names a column that
    expected copies are proportional to inside a source, up to `most` (null: 1, negative: 0; three digits
    count); without one it is the number of binary digits of size.  A null source is a source of its own; rows alike in doc_id, text and source are taken together or not at all; a source
    without words has target 0; other columns are not read.  Empty table: no rows.
    """
    rows, plan = allocation_plan(docs, seed, weights, most, preference)
    return _decided(_ranked(rows, plan, most)).select("doc_id", "source", "size", "source_size", "target", "copies")


def allocation_plan(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int, preference: str | None) -> tuple[DataFrame, DataFrame]:
    """Staged: every row's size and random number; every source's target and where its sample ends."""
    rows = stage(docs.select(*_drawn(docs, seed, preference)), "sizes")
    classes = stage(rows.groupBy("source", "prefer").agg(F.sum("size").alias("words")), "classes")
    sums = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = stage(levels(classes, stage(targets(sums, weights, most), "targets"), most), "aims")

    placed = _ranked(rows, aims, most)
    wants = placed.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("want"))
    state = stage(wants.withColumn("low", F.lit(0.0)).withColumn("width", F.lit(1.0)).withColumn("head", F.lit(0.0)), "state")

    cut = F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * _BINS), F.lit(_BINS - 1)).cast("long")
    for _ in range(2):
        inside = _beside(placed.where("rank is not null").select("source", "rank", "size"), state).where("rank >= low and rank < low + width").withColumn("bin", cut)
        bins = inside.groupBy("source", "want", "low", "width", "head", "bin").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        crossing = bins.withColumn("upto", F.col("head") + upto).where("upto > want").groupBy("source").agg(F.min_by(F.struct("want", "low", "width", "words", "upto", "bin"), "bin").alias("b"))
        state = stage(
            crossing.select("source", "b.want", (F.col("b.low") + F.col("b.bin") * (F.col("b.width") / _BINS)).alias("low"), (F.col("b.width") / _BINS).alias("width"), (F.col("b.upto") - F.col("b.words")).alias("head")),
            "state",
        )
    # A source that never crosses (nothing is wanted, or all of it fits) keeps no state: see `all_in`.
    last = _beside(placed.where("rank is not null").select("source", "rank", "id", "size"), state).where("rank >= low and rank < low + width")
    last = last.groupBy("source", "want", "head", "rank", "id").agg(F.sum("size").alias("words"))
    running = last.withColumn("upto", F.col("head") + F.sum("words").over(Window.partitionBy("source").orderBy("rank", "id")))
    firsts = running.where("upto > want").groupBy("source").agg(F.min_by(F.struct("want", "rank", "id", "words", "upto"), F.struct("rank", "id")).alias("b"))
    edge = stage(firsts.select("source", F.col("b.rank").alias("edge_rank"), F.col("b.id").alias("edge_id"), (F.col("b.want") - (F.col("b.upto") - F.col("b.words"))).alias("left")), "edge")
    none = F.array().cast("array<struct<rank:double,id:bigint>>")
    closing = edge.select("source", "edge_rank", "edge_id", F.col("left"), none.alias("closing"))
    for _ in range(CLOSING):
        beyond = _beside(placed.where("rank is not null and size > 0").select("source", "rank", "id", "size"), closing).where(F.struct("rank", "id") >= F.struct("edge_rank", "edge_id"))
        beyond = beyond.where(~F.array_contains("closing", F.struct("rank", "id"))).groupBy("source", "rank", "id", "left").agg(F.sum("size").alias("words"))
        off = F.abs(F.col("words") - F.col("left"))
        nearest = beyond.where(off < F.col("left")).groupBy("source").agg(F.min_by(F.struct("rank", "id", "words"), F.struct(off, F.col("rank"), F.col("id"))).alias("c"))
        joined = closing.join(nearest.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        added = F.when(F.col("c").isNull(), F.col("closing")).otherwise(F.array_append("closing", F.struct("c.rank", "c.id")))
        closing = stage(joined.select("source", "edge_rank", "edge_id", (F.col("left") - F.coalesce("c.words", F.lit(0))).alias("left"), added.alias("closing")), "closing")
    plan = stage(aims.join(closing.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "level", "edge_rank", "edge_id", "closing"), "plan")
    return rows, plan


def _decided(df: DataFrame) -> DataFrame:
    """copies: the certain ones, and one more before the edge of the source's order or among its closing rows."""
    here = F.struct("rank", "id")
    head = F.col("edge_rank").isNull() | (here < F.struct("edge_rank", "edge_id"))
    extra = F.col("rank").isNotNull() & (head | F.coalesce(F.array_contains("closing", here), F.lit(False)))
    return df.withColumn("copies", F.col("certain") + F.coalesce(extra, F.lit(False)).cast("long"))
