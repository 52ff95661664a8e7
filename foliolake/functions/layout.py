"""Layout routing rules and parsers of layout responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model of each complexity.
MODELS = {"simple": "glm-4.6v-flash", "moderate": "glm-4.6v-flashx", "complex": "glm-4.6v"}


def escalation_detect(chars: Column, confidence: Column, zero_text: int = 0, chaos: float = 0.3) -> Column:
    """zero_text, layout_chaos or normal; thresholds out of range raise."""
    if zero_text < 0 or not 0 <= chaos <= 1:
        raise ValueError("zero_text must not be negative, chaos must lie in [0, 1]")
    return F.when(chars <= zero_text, "zero_text").when(confidence < chaos, "layout_chaos").otherwise("normal")


def layout_confidence(text: Column, lines: Column) -> Column:
    size = F.octet_length(text)
    return F.when(size < 10, 0.0).otherwise(0.5 * F.least(lines / 10, F.lit(1.0)) + 0.5 * F.least(size / 500, F.lit(1.0)))


def page_complexity(chars: Column, confidence: Column) -> Column:
    """simple, moderate or complex; null characters or confidence: complex."""
    return F.when((chars > 500) & (confidence > 0.7), "simple").when((chars >= 50) & (confidence >= 0.3), "moderate").otherwise("complex")


def select_model(complexity: Column, models: dict[str, str] | None = None) -> Column:
    """The model for a complexity; null and unknown ones get the model for complex pages."""
    m = models or MODELS
    return F.when(complexity == "simple", m["simple"]).when(complexity == "moderate", m["moderate"]).otherwise(m["complex"])


def route_pages(pages: DataFrame) -> DataFrame:
    """(path, page_number, chars, confidence, complexity, model, reason) of every page."""
    p = pages.select("path", "page_number", F.length("text").alias("chars"), layout_confidence(F.col("text"), F.size("lines")).alias("confidence"))
    return p.withColumn("complexity", page_complexity(F.col("chars"), F.col("confidence"))).withColumn("model", select_model(F.col("complexity"))).withColumn("reason", escalation_detect(F.col("chars"), F.col("confidence")))


def vlm_triggered(routed: DataFrame) -> DataFrame:
    return routed.groupBy("path").agg(F.bool_or(F.col("reason") != "normal").alias("vlm_triggered"))


# A box of four numbers, and the words that name a region's type with the type they name.
_NUMBER = r"(\d+(?:\.\d+)?)"
_BOX = rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]"
REGION_WORDS = {"title": "title", "body": "body", "table": "table", "image": "image", "caption": "caption", "paragraph": "body", "heading": "body"}


def _kind(word: Column, kinds: dict[str, str]) -> Column:
    out = F.lit("body")
    for name, kind in kinds.items():
        out = F.when(word == name, kind).otherwise(out)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value made once: inside a lambda it would be made anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_layout_text(text: Column, reach: int = 50) -> Column:
    """Every [a, b, c, d] in a text as (region_type, x, y, width, height, content).

    The type is that of the known word which comes first, in any case, from `reach` characters before the box to
    `reach` after it; body if there is none.  content is the box as it stands.  Null text: null; no box: empty.
    """
    # No box is shorter than nine characters, so as many pairs of gap and box reach far enough to either side.
    pairs = -(-reach // 9)
    kinds = F.create_map(*[F.lit(x) for item in REGION_WORDS.items() for x in item])
    words = rf"(?i)({'|'.join(REGION_WORDS)})"

    def regions(one: Column) -> Column:
        boxes, gaps = one["boxes"], one["gaps"]
        ends = F.transform(gaps, lambda g: F.right(g, F.lit(reach)))
        starts = F.transform(gaps, lambda g: F.left(g, F.lit(reach)))
        sides = F.struct(boxes.alias("boxes"), ends.alias("ends"), starts.alias("starts"), F.zip_with(ends, boxes, lambda g, x: F.concat(g, x)).alias("to"), F.zip_with(F.slice(starts, 2, F.size(starts)), boxes, lambda g, x: F.concat(x, g)).alias("on"))
        return _let(sides, lambda s: F.transform(s["boxes"], lambda box, k: region(s, box, k)))

    def region(s: Column, box: Column, k: Column) -> Column:
        first = F.greatest(k - pairs, F.lit(0))
        before = F.right(F.concat(F.array_join(F.slice(s["to"], first + 1, k - first), ""), F.get(s["ends"], k)), F.lit(reach))
        after = F.left(F.concat(F.get(s["starts"], k + 1), F.array_join(F.slice(s["on"], k + 2, F.lit(pairs)), "")), F.lit(reach))
        kind = F.coalesce(F.element_at(kinds, F.lower(F.regexp_extract(F.concat(before, box, after), words, 1))), F.lit("body"))
        numbers = F.transform(F.split(F.substring(box, F.lit(2), F.length(box) - 2), ","), lambda n: n.cast("double"))
        return _let(
            F.struct(numbers.alias("n"), kind.alias("kind"), box.alias("box")),
            lambda r: F.struct(r["kind"].alias("region_type"), r["n"][0].alias("x"), r["n"][1].alias("y"), (r["n"][2] - r["n"][0]).alias("width"), (r["n"][3] - r["n"][1]).alias("height"), r["box"].alias("content")),
        )

    return _let(F.struct(F.regexp_extract_all(text, F.lit(_BOX), F.lit(0)).alias("boxes"), F.split(text, _BOX, -1).alias("gaps")), regions)


def region_rows(parsed: DataFrame, column: str = "r") -> DataFrame:
    """parsed with a row for each region of `column` and the region's fields in its place; without regions there is no row.

    By an outer inline: for an inner one Spark filters on the column first, and makes it anew for each filter.
    """
    return parsed.select(*[c for c in parsed.columns if c != column], F.inline_outer(column)).where("region_type is not null")


_DETAIL = "struct<layout_details:array<array<struct<label:string,bbox_2d:array<double>,content:string>>>>"
# Labels that are kept if they come with content and a box, and the region types they stand for.
OCR_LABELS = {"text": "body", "title": "title", "caption": "caption", "table": "table", "list": "body"}
#: Content of an image, which needs neither content nor box.
IMAGE_CONTENT = "[image]"


def parse_ocr_json(response: Column) -> Column:
    """Regions (region_type, x, y, width, height, content) of a nested OCR response, in order.

    Labels count as they are written; others than those of OCR_LABELS and image are dropped.  An image without
    a box lies at 0 with no size.  A response that is null or no JSON: null.
    """
    items = F.flatten(F.from_json(response, _DETAIL)["layout_details"])
    boxed = lambda x: F.size(x["bbox_2d"]) == 4
    kept = F.filter(items, lambda x: (x["label"] == "image") | x["label"].isin(*OCR_LABELS) & x["content"].isNotNull() & F.coalesce(boxed(x), F.lit(False)))
    at = lambda x, k: F.when(F.coalesce(boxed(x), F.lit(False)), F.get(x["bbox_2d"], F.lit(k))).otherwise(0.0)
    image = lambda x: x["label"] == "image"
    return F.transform(
        kept,
        lambda x: F.struct(
            F.when(image(x), "image").otherwise(_kind(x["label"], OCR_LABELS)).alias("region_type"), at(x, 0).alias("x"), at(x, 1).alias("y"), (at(x, 2) - at(x, 0)).alias("width"), (at(x, 3) - at(x, 1)).alias("height"),
            F.when(image(x), IMAGE_CONTENT).otherwise(x["content"]).alias("content"),
        ),
    )


def parse_chat(response: Column) -> Column:
    """Regions in the first choice of a chat response."""
    return parse_layout_text(F.get_json_object(response, "$.choices[0].message.content"))


def retry_backoff(attempt: Column, base: float = 1.0, most: float = 30.0, jitter: float = 0.1) -> Column:
    """Seconds to wait: base doubled each time, at most `most`, and a tenth more."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)) * (1 + jitter)


def client_retry(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def hint_truncate(text: Column, most: int = 10_000) -> Column:
    """The text's first `most` bytes, less a character that they cut; shorter texts and null as they are."""
    raw = text.cast("binary")
    inside = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    # A character takes four bytes at most: the first byte after the cut that begins one says where it may lie.
    cut = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) > most, F.substr(raw, F.lit(1), cut).cast("string")).otherwise(text)


def image_url(image: Column, mime: str = "image/png") -> Column:
    """Bytes as a data URL, as requests carry them (files: application/pdf); null stays null."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(image), "\r\n", ""))


def image_bytes(url: Column) -> Column:
    """The bytes of a data URL; null for anything else."""
    return F.when(F.regexp_like(url, F.lit("^data:[^,;]*;base64,")), F.unbase64(F.substring_index(url, ",", -1)))


def trace_id(*key: Column) -> Column:
    """A request's UUID: random, or with a key one that is the same for the same key."""
    if not key:
        return F.expr("uuid()")
    h = F.md5(F.concat_ws("\x01", *key))
    part = lambda at, n: F.substring(h, at, n)
    # Version 4 and its variant stand where a random UUID has them.
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def backpressure_interval(rate: Column) -> Column:
    """Milliseconds between polls: 1 s, and from a rate of 0.8 on 5 s to 30 s."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
    return F.when(r >= 0.8, F.least(F.lit(30000.0), 5000 + (r - 0.8) / 0.2 * 25000)).otherwise(1000.0)
