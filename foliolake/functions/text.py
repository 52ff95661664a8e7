"""Text operators: tokens, term statistics, ranked search, keyword search, snippets, TF-IDF."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load, release, save, spread, stage

#: A run of ASCII letters and digits, or any one other character that is not white space.
LATIN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"
#: The same with the letters and digits of all scripts.
UNICODE = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "latin": lambda c: F.regexp_extract_all(c, F.lit(LATIN), F.lit(0)),
    "unicode": lambda c: F.regexp_extract_all(c, F.lit(UNICODE), F.lit(0)),
}


def dictionary_tokenizer(frequencies: dict[str, float]) -> Callable[[Column], Column]:
    """A tokenizer that cuts runs of CJK characters into the words of a dictionary, and all else as `unicode` does.

    Of all ways to cut a run the one whose words' relative frequencies have the largest product is taken; a
    character that begins no word stands alone, as rare as a word that occurs once.  Ties go to longer words.
    White space is no token; null text gives null.
    """
    total = math.log(sum(frequencies.values()) or 1.0)
    worth = {w: math.log(n) - total for w, n in frequencies.items() if w and n > 0}
    longest = max(map(len, worth), default=1)
    pieces = re.compile(r"([\u3400-\u9fff\uf900-\ufaff]+)|([^\W_]+)|(\S)")

    def cut(run: str) -> list[str]:
        best = [(0.0, 1)] * (len(run) + 1)  # from each place on: the best product, and the length of its first word
        for at in range(len(run) - 1, -1, -1):
            lengths = [n for n in range(1, min(longest, len(run) - at) + 1) if n == 1 or run[at : at + n] in worth]
            best[at] = max((worth.get(run[at : at + n], -total) + best[at + n][0], n) for n in lengths)
        out, at = [], 0
        while at < len(run):
            out.append(run[at : at + best[at][1]])
            at += best[at][1]
        return out

    def words(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out: list[str] = []
        for m in pieces.finditer(text):
            if m[1]:
                out += cut(m[1])
            elif m[2]:  # CJK characters beside letters of other scripts are cut as well
                for part in re.split(r"([\u3400-\u9fff\uf900-\ufaff]+)", m[2]):
                    out += cut(part) if re.match(r"[\u3400-\u9fff\uf900-\ufaff]", part) else [part] if part else []
            else:
                out.append(m[3])
        return out

    @F.pandas_udf("array<string>")
    def tokenize(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    return tokenize


def register_tokenizer(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Makes a text-to-tokens expression (or pandas UDF) available by name."""
    TOKENIZERS[name] = tokenizer


def tokens(text: Column, tokenizer: str = "latin", lowercase: bool = False) -> Column:
    """Tokens in order, punctuation kept, case kept unless lowercase."""
    return TOKENIZERS[tokenizer](F.lower(text) if lowercase else text)


def tfidf_tokens(text: Column, tokenizer: str = "latin") -> Column:
    """Lower-case tokens of more than one byte."""
    return F.filter(tokens(text, tokenizer, True), lambda t: F.octet_length(t) > 1)


def token_rows(docs: DataFrame, text: str = "body", **how) -> DataFrame:
    """(path, position, token)."""
    return docs.select("path", F.posexplode(tokens(F.col(text), **how)).alias("position", "token"))


def term_frequency_topn(docs: DataFrame, n: int = 10, text: str = "body") -> DataFrame:
    """(term, n) most frequent words of two letters or more; letters are ASCII or CJK; ties by term."""
    words = F.explode(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s一-龥]", " "), r"\s+"))
    return docs.select(words.alias("term")).where(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value made once: inside a lambda it would be made anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (path, tokens) to (path, total, t), t an array of (term, n)."""
    for batch in batches:
        path, held = batch.column(0), batch.column(1)
        flat = pa.table({"row": pc.list_parent_indices(held), "term": held.flatten()}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        flat = flat.take(pa.array(np.argsort(np.asarray(flat.column("row")), kind="stable"))).combine_chunks()
        row = np.asarray(flat.column("row"))
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        column = lambda name: flat.column(name).chunk(0) if flat.num_rows else pa.array([], flat.schema.field(name).type)
        pairs = pa.StructArray.from_arrays([column("term"), column("count_all")], ["term", "n"])
        yield pa.RecordBatch.from_arrays([path, pc.fill_null(pc.list_value_length(held), 0), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["path", "total", "t"])


def _held_terms(docs: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """(path, total, t array<term, n>): each row's terms counted where the row is, nothing is shuffled."""
    own = docs.select("path", tfidf_tokens(F.col(text), tokenizer).alias("t"))
    return own.mapInArrow(_counted, f"path {own.schema['path'].dataType.simpleString()}, total int, t array<struct<term:string,n:bigint>>")


def term_counts(docs: DataFrame, text: str = "body", tokenizer: str = "latin") -> DataFrame:
    """(path, term, n, total): each row's terms with their number and that of all its terms; rows that share a path stay apart."""
    return _held_terms(docs, text, tokenizer).select("path", "total", F.inline("t")).select("path", "term", "n", "total")


def inverse_document_frequency(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) of term_counts, idf = ln((N + 1) / (df + 1)) + 1 with N the rows of docs."""
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def document_frequency(docs: DataFrame, text: str = "body", tokenizer: str = "latin") -> DataFrame:
    """(term, df, idf), idf = ln((N + 1) / (df + 1)) + 1; a row without text counts in N only, each row is a document."""
    return inverse_document_frequency(term_counts(docs, text, tokenizer), docs)


#: Terms whose idf is broadcast; with more, weights are joined to them by a shuffle.
BROADCAST_TERMS = 500_000


def tfidf_weights(docs: DataFrame, idf: DataFrame | None = None, text: str = "body", tokenizer: str = "latin") -> DataFrame:
    """(path, term, weight): exact sparse vectors of unit length; terms without an idf count as 1.

    Texts are tokenised once; idf(term, idf) comes from them unless it is given.  A row is a document: paths
    are expected not to repeat.  Null texts and texts without terms have no rows.
    """
    held = stage(_held_terms(docs, text, tokenizer), "terms")
    counts = held.select("path", "total", F.inline("t"))
    known = stage(inverse_document_frequency(counts, docs).select("term", "idf"), "idf") if idf is None else idf.select("term", "idf")
    few = known.count() <= BROADCAST_TERMS
    weighed = counts.join(F.broadcast(known) if few else known, "term", "left").select("path", "term", (F.col("n") / F.col("total") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    if few:  # a row's terms come one after another, from one task
        return weighed.mapInArrow(_unit, f"path {weighed.schema['path'].dataType.simpleString()}, term string, weight double")
    rows = weighed.groupBy("path").agg(F.collect_list(F.struct("term", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select("path", "norm", F.inline("t")).select("path", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (path, term, w), a path's rows together, to (path, term, weight) of unit length."""

    def scaled(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = np.asarray(rows.column(2))
        norms = np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), np.diff(np.append(starts, len(w))))
        with np.errstate(all="ignore"):
            yield from pa.table([rows.column(0), rows.column(1), pa.array(w / norms)], names=["path", "term", "weight"]).to_batches()

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        path = rows.column(0).combine_chunks()
        turns = np.asarray(pc.fill_null(pc.not_equal(path[1:], path[:-1]), False))
        starts = np.append(0, np.flatnonzero(turns) + 1)
        if starts[-1]:
            yield from scaled(rows.slice(0, starts[-1]), starts[:-1])
        rest = rows.slice(starts[-1])  # it may go on in the next batch
    if rest is not None:
        yield from scaled(rest, np.array([0]))


def hashed_vectors(weights: DataFrame, dim: int = 256) -> DataFrame:
    """(path, vector array<float>): weights summed into dim buckets by a hash of the term, unit length; only paths that have weights."""
    slots = weights.groupBy("path", F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("slot")).agg(F.sum("weight").alias("w"))
    dense = slots.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value = lambda k: F.when(F.col("norm") > 0, F.coalesce(F.element_at("m", k), F.lit(0.0)) / F.col("norm")).otherwise(0.0).cast("float")
    return dense.select("path", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))


def tfidf_similar(weights: DataFrame, path: str, k: int = 10) -> DataFrame:
    """(path, score): the k documents nearest to one by exact TF-IDF cosine; only its terms are joined."""
    mine = weights.where(F.col("path") == path).select("term", F.col("weight").alias("q"))
    scores = weights.where(F.col("path") != path).join(mine, "term").groupBy("path").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return scores.orderBy(F.desc(F.round("score", 9)), "path").limit(k)


# ---- full text -----------------------------------------------------------------------------------

FIELDS = ("title", "body", "tags")
K1, B = 1.2, 0.75


def index_documents(entries: DataFrame, filename: str = "path") -> DataFrame:
    """path, title, domain, tags and body as they are indexed: no title falls back to the file's name."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.md$", ""), "_", " ")
    return entries.select("path", F.coalesce("title", stem).alias("title"), F.coalesce("domain", F.lit("")).alias("domain"), F.array_join(F.coalesce("tags", F.array()), " ").alias("tags"), F.coalesce("body", F.lit("")).alias("body"))


#: Rows whose terms are placed together.
ROWS_PLACED = 512


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (path, field, tokens) to (term, field, path, tf, positions), a row for each term of a row."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_PLACED):
            batch = whole.slice(start, ROWS_PLACED)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0)).astype(np.int64)
            words = batch.column(2).flatten().dictionary_encode(null_encoding="encode")
            row, code = np.repeat(np.arange(batch.num_rows), sizes), np.asarray(words.indices).astype(np.int64)
            at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            key = row * max(1, len(words.dictionary)) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(row)).astype(np.int32)
            mine = order[first]
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(code[mine])), batch.column(1).take(pa.array(row[mine])), batch.column(0).take(pa.array(row[mine])), pa.array(np.diff(ends).astype(np.int64)), places],
                names=["term", "field", "path", "tf", "positions"],
            )


def rebuild_index(entries: DataFrame, lowercase: bool = False, tokenizer: str = "latin") -> tuple[DataFrame, DataFrame]:
    """(postings(term, field, path, tf, positions), lengths(path, field, len)) over title, body and tags.

    A field's positions are gathered inside its row, so nothing is shuffled.
    """
    docs = index_documents(entries)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f), tokenizer, lowercase).alias("t")) for f in FIELDS]))
    each = docs.select("path", fields.alias("f")).select("path", "f.field", "f.t")
    lengths = each.select("path", "field", F.size("t").cast("long").alias("len"))

    placed = each.where(F.size("t") > 0).mapInArrow(_placed, f"term string, field string, path {each.schema['path'].dataType.simpleString()}, tf bigint, positions array<int>")
    return placed, lengths


#: Folders of a saved index that terms are dealt to.
INDEX_PARTS = 64


def _index_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_PARTS)).cast("int")


def save_index(index: tuple[DataFrame, DataFrame], root: str) -> None:
    """Writes an index below root: postings by part and sorted by term, so that a search reads little of them."""
    postings, lengths = index
    dealt = postings.withColumn("part", _index_part(F.col("term")))
    # A part holds many terms; a frequent one is spread over several files of its part.
    spread = F.pmod(F.xxhash64("path"), F.lit(4))
    rows = dealt.repartition(F.col("part"), spread).sortWithinPartitions("part", "term", "path")
    save(rows, f"{root}/postings", "part")
    save(lengths, f"{root}/lengths")


def load_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) as they were saved; a missing index raises."""
    return load(spark, f"{root}/postings", required=("term", "field", "path", "tf", "positions")), load(spark, f"{root}/lengths", required=("path", "field", "len"))


@dataclass(frozen=True)
class Clause:
    """One part of a query: must is True for +, False for -, None for neither."""

    terms: tuple[str, ...]
    field: str | None = None
    must: bool | None = None


_QUERY = r'([+-]?)(?:([A-Za-z_]+):)?(?:"([^"]*)"|(\S+))'


def query_words(spark: SparkSession, query: str, tokenizer: str, lowercase: bool = False) -> dict[str, tuple[str, ...]]:
    """The tokens of each part of a query, by the tokenizer that made the index."""
    parts = sorted({phrase or word for _, _, phrase, word in re.findall(_QUERY, query)})
    rows = spark.createDataFrame([(p,) for p in parts], "part string").select("part", tokens(F.col("part"), tokenizer, lowercase).alias("t"))
    return {r["part"]: tuple(r["t"]) for r in rows.collect()}  # a row for each part of the query


def parse_query(query: str, lowercase: bool = False, words: dict[str, tuple[str, ...]] | None = None) -> list[Clause]:
    """Words, "phrases", field:word, + and -, AND, OR and NOT; words beside each other are alternatives.

    AND makes both its sides required, NOT the next one forbidden.  words has the tokens of the query's parts; without it
    they are those of the `latin` tokenizer.
    """
    out: list[Clause] = []
    pending: bool | None = None
    for sign, field, phrase, word in re.findall(_QUERY, query):
        if word in ("AND", "OR", "NOT") and not sign and not field:
            if word == "AND" and out and out[-1].must is None:
                out[-1] = Clause(out[-1].terms, out[-1].field, True)
            pending = {"AND": True, "OR": None, "NOT": False}[word]
            continue
        text = phrase or word
        cut = tuple(re.findall(LATIN, text.lower() if lowercase else text)) if words is None else words[text]
        parts = cut if field != "domain" else (text,)
        if parts:
            out.append(Clause(parts, field or None, {"+": True, "-": False}.get(sign, pending)))
        pending = None
    return out


def search_knowledge(entries: DataFrame, query: str, k: int = 10, index: tuple[DataFrame, DataFrame] | None = None, lowercase: bool = False, tokenizer: str = "latin") -> DataFrame:
    """(path, title, domain, score): BM25 over title, body and tags, best k first, ties by path.

    Only postings of the query's terms are read; score is the sum over fields and terms of
    idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * len / average)), idf = ln(1 + (N - n + .5) / (n + .5)).
    k below 1 gives none.  The query is cut by the same tokenizer as the texts; an index has to be one that it made.
    """
    clauses = parse_query(query, lowercase, None if tokenizer == "latin" else query_words(entries.sparkSession, query, tokenizer, lowercase))
    docs = index_documents(entries)
    if k < 1 or not any(c.must is not False for c in clauses):
        return docs.select("path", "title", "domain", F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for c in clauses for t in c.terms if c.field != "domain"})
    if index:
        postings, lengths = index
        if "part" in postings.columns:
            postings = postings.where(F.col("part").isin([r["p"] for r in postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(_index_part(F.col("t")).alias("p")).distinct().collect()]))
        asked = postings.where(F.col("term").isin(terms)).select("path", "field", "term", "tf", "positions").join(lengths, ["path", "field"])
    else:
        asked, lengths = _looked_up(docs, terms, lowercase, tokenizer)
    totals = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("average"))
    n = asked.groupBy("term", "field").agg(F.count("*").alias("n"))
    # One row for each field, and for each term and field asked for: bounded by the query.
    hits = asked.join(F.broadcast(totals), "field").join(F.broadcast(n), ["term", "field"])
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    score = idf * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("average")))
    per_doc = hits.select("path", "term", "field", "positions", score.alias("score")).groupBy("path").agg(F.collect_list(F.struct("term", "field", "positions", "score")).alias("h"))
    by_domain = any(c.field == "domain" for c in clauses)
    found = per_doc
    if not terms:
        found = docs.select("path", "domain", F.array().cast("array<struct<term:string,field:string,positions:array<int>,score:double>>").alias("h"))
    elif by_domain:
        found = per_doc.join(docs.select("path", "domain"), "path")

    def holds(c: Clause) -> Column:
        if c.field == "domain":
            return F.col("domain") == c.terms[0]
        fields = [c.field] if c.field else list(FIELDS)
        at = lambda t, f: F.flatten(F.transform(F.filter("h", lambda x: (x["term"] == t) & (x["field"] == f)), lambda x: x["positions"]))
        one = []
        for f in fields:
            start = at(c.terms[0], f)
            for d, t in enumerate(c.terms[1:], 1):
                start = F.array_intersect(start, _moved(at(t, f), d))
            one.append(F.size(start) > 0)
        out = one[0]
        for x in one[1:]:
            out = out | x
        return out

    scored = [c for c in clauses if c.must is not False and c.field != "domain"]
    counts = lambda x: F.lit(False) if not scored else _any([x["term"].isin(list(c.terms)) & (F.lit(True) if c.field is None else x["field"] == c.field) for c in scored])
    total = F.aggregate(F.transform(F.filter("h", counts), lambda x: x["score"]), F.lit(0.0), lambda s, x: s + x)
    must, must_not, may = ([c for c in clauses if c.must is m] for m in (True, False, None))
    keep = F.lit(True)
    for c in must:
        keep = keep & holds(c)
    for c in must_not:
        keep = keep & ~holds(c)
    if not must:
        keep = keep & _any([holds(c) for c in may])
    best = found.where(keep).select("path", total.alias("score")).orderBy(F.desc("score"), "path").limit(k)
    # k rows look up their titles.
    return docs.select("path", "title", "domain").join(F.broadcast(best), "path").select("path", "title", "domain", "score").orderBy(F.desc("score"), "path").limit(k)


def _looked_up(docs: DataFrame, terms: list[str], lowercase: bool, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms, and all lengths, from one pass over documents that have no index yet."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f), tokenizer, lowercase).alias("t")) for f in FIELDS]))
    each = docs.select("path", fields.alias("f")).select("path", "f.field", "f.t")
    places = lambda term: F.filter(F.transform("t", lambda x, k: F.when(x == term, k)), lambda k: k.isNotNull())
    held = F.filter(F.array(*[F.when(F.array_contains("t", t), F.struct(F.lit(t).alias("term"), places(t).alias("positions"))) for t in terms]), lambda x: x.isNotNull())
    seen = stage(each.select("path", "field", F.size("t").cast("long").alias("len"), held.alias("h")), "looked_up")
    rows = seen.select("path", "field", "len", F.inline("h"))
    return rows.withColumn("tf", F.size("positions").cast("long")), seen.select("path", "field", "len")


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def snippet(content: Column, query: str, before: int = 100, after: int = 200) -> Column:
    """Around the first occurrence of the whole query in any case, in characters; "" if there is none."""
    at = F.locate(query.lower(), F.lower(content))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(content, start, at + len(query) + after - start)).otherwise("")


def search_keywords(pages: DataFrame, keywords: list[str], case_sensitive: bool = False, context: int = 50) -> DataFrame:
    """(path, page_number, keyword, position, matched, context): all non-overlapping matches, page by page.

    Keywords are literal; without case_sensitive letters of all scripts match in any case.  Positions are
    characters in the page's text, from 0.  Matching each page by itself makes the page exact.  Empty and
    null keywords and null texts match nothing; a keyword that repeats is found as often.  However many keywords there
    are, a page is read once and copied only for those that it holds.
    """
    words = [w for w in keywords if w]
    if not words:
        return pages.select("path", "page_number", F.lit("").alias("keyword"), F.lit(0).alias("position"), F.lit("").alias("matched"), F.lit("").alias("context")).limit(0)
    text = F.col("text")
    # One pass finds the keywords that a page may hold: what is equal in any case is equal when folded.  Only they get a row.
    # (The inner translate keeps the optimizer from taking lower(upper(x)) for lower(x), which it is not for all scripts.)
    fold = (lambda c: c) if case_sensitive else (lambda c: F.translate(F.lower(F.translate(F.upper(c), "ς", "Σ")), "ς\u0307", "σ"))
    asked = F.array(*[F.struct(F.lit(w).alias("word"), fold(F.lit(w)).alias("folded")) for w in words])
    held = _let(F.struct(fold(text).alias("folded")), lambda one: F.filter(asked, lambda w: F.contains(one["folded"], w["folded"])))
    each = pages.where(text.isNotNull()).select("path", "page_number", "text", F.explode(held).alias("w")).select("path", "page_number", "text", F.col("w.word").alias("keyword"))
    pattern = F.concat(F.lit("" if case_sensitive else "(?iu)"), F.regexp_replace("keyword", r"([\\^$.|?*+()\[\]{}-])", r"\\$1"))
    each = each.withColumn("pattern", pattern).where(F.regexp_like("text", F.col("pattern")))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    step = 256

    def places(one: Column) -> Column:
        """The text between matches gives their places: sums of what lies before, by blocks of `step` matches."""
        n = F.size(one["found"])
        longs = F.zip_with(F.slice(one["gaps"], F.lit(1), n), one["found"], lambda g, m: F.length(g) + F.length(m))
        return _let(F.struct(longs.alias("n")), lambda l: _let(blocks(l["n"]), lambda b: F.transform(one["found"], lambda m, k: F.struct((before(l["n"], b, k) + F.length(F.get(one["gaps"], k))).alias("position"), m.alias("matched")))))  # noqa: E741

    def blocks(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / step).cast("int")), lambda b: add(F.slice(n, b * step + 1, step)))
        return _let(sums, lambda s: F.transform(s, lambda _, b: add(F.slice(s, F.lit(1), b))))

    def before(n: Column, sums: Column, k: Column) -> Column:
        b = F.floor(k / step).cast("int")
        return F.get(sums, b) + add(F.slice(n, b * step + 1, k - b * step))

    bound = F.struct(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found"), F.split("text", F.col("pattern"), -1).alias("gaps"))
    hit = each.select("path", "page_number", "text", "keyword", F.explode(_let(bound, places)).alias("m"))
    start = F.greatest(F.lit(0), F.col("m.position") - context)
    return hit.select("path", "page_number", "keyword", F.col("m.position").alias("position"), F.col("m.matched").alias("matched"), F.substring(text, start + 1, F.col("m.position") + F.length("m.matched") + context - start).alias("context"))


def search_keywords_client(texts: DataFrame, keywords: list[str], case_sensitive: bool = False, context: int = 50) -> DataFrame:
    """(path, keyword, position, matched, context) over whole texts(path, text) without pages."""
    return search_keywords(texts.select("path", F.lit(0).alias("page_number"), "text"), keywords, case_sensitive, context).drop("page_number")


def keyword_totals(matches: DataFrame) -> DataFrame:
    """(keyword, matches, pages)."""
    return matches.groupBy("keyword").agg(F.count("*").alias("matches"), F.countDistinct("path", "page_number").alias("pages"))


def find_page(pages: DataFrame, positions: DataFrame) -> DataFrame:
    """(path, position, page_number): the page in whose running text, page by page, a position lies.

    Each position comes once; of pages that begin at one place the last counts; positions before the first page
    or of an unknown path are left out.
    """
    bounds = page_boundaries(pages).select("path", F.col("start").alias("at"), F.lit(0).alias("asks"), "page_number")
    asked = positions.select("path", "position").distinct()
    both = bounds.withColumn("position", F.lit(None).cast(asked.schema["position"].dataType)).unionByName(asked.select("path", F.col("position").cast("long").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("page_number"), "position"))
    # As-of: one sort of a path's pages and positions, and the last page so far.
    so_far = Window.partitionBy("path").orderBy("at", "asks", "page_number").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("page_number", F.last("page_number", ignorenulls=True).over(so_far))
    return found.where("asks = 1 and page_number is not null").select("path", "position", "page_number")


def page_boundaries(pages: DataFrame) -> DataFrame:
    """(path, page_number, start): trimmed characters of the pages before."""
    earlier = Window.partitionBy("path").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select("path", "page_number", F.coalesce(F.sum(F.length(F.trim("text"))).over(earlier), F.lit(0)).cast("long").alias("start"))


def trigrams(text: Column) -> Column:
    """The set of letter triples of a string in lower case, blanks around it."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda k: F.substring(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), k, 3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the trigrams of two strings."""
    return F.size(F.array_intersect(trigrams(a), trigrams(b))) / F.size(F.array_union(trigrams(a), trigrams(b)))


#: Names of one side and length that lie in a block at most, and rows of a block that are counted at once.
NAMES_HELD, NAMES_COUNTED = 8192, 512
_BLOCK = "side int, n int, id string, names array<string>, grams array<string>, held binary"


def similar_names(left: DataFrame, right: DataFrame | None = None, least: float = 0.4) -> DataFrame:
    """(left, right, similarity) of all pairs of different names(name), one of each side, at least so alike by trigrams.

    Without right, pairs within left, each once with the smaller name first.  Copies of a name count once; null names have
    no partner.  Names with equally many trigrams lie in blocks, neighbours by name together.  Two blocks meet in one row
    if neither's sets are longer than the other's / least, and their shared trigrams are counted in numpy, from those
    trigrams that stand in both: no row is made for a pair that is not alike.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    within, sides = right is None, [x.select("name").where("name is not null").distinct() for x in (left, *([] if right is None else [right]))]
    names = sides[0].select("name", F.lit(0).alias("side")) if within else sides[0].select("name", F.lit(0).alias("side")).unionByName(sides[1].select("name", F.lit(1).alias("side")))
    # Dealt by both: dealt by name as distinct() left them, Spark would keep its few tasks.
    sets = stage(spread(names, "name", "side").select("side", "name", trigrams(F.col("name")).alias("g")).select("side", F.size("g").alias("n"), "name", "g"), "trigrams")
    # Neighbours share most of their trigrams, and what a whole run of rows shares is counted once.
    blocks = stage(sets.repartitionByRange("side", "n", "name").sortWithinPartitions("side", "n", "name").mapInArrow(_name_blocks, _BLOCK), "names")
    release(sets)
    a = blocks.where("side = 0").select("n", F.col("id").alias("a"), F.struct("n", "names", "grams", "held").alias("x"))
    b = blocks.where(f"side = {0 if within else 1}")
    # By each length of the other side that can be so alike.
    longest = blocks.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    alike = F.filter(F.sequence(F.lit(0), F.lit(longest)), lambda x: (x >= least * F.col("n") - 1e-9) & (F.col("n") >= least * x - 1e-9))
    partners = b.select(F.col("id").alias("b"), F.explode(alike).alias("n"))
    # Merged, never broadcast: blocks take more room in memory than their files say.
    met = a.join(partners.hint("merge"), "n").drop("n")
    if within:
        met = met.where("a <= b")
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b")
    rows = met.join(b.select(F.col("id").alias("b"), F.struct("n", "names", "grams", "held").alias("y")).hint("merge"), "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                yield from _alike(batch.column(2)[k], batch.column(3)[k], least, within, same)

    return rows.select("a", "b", "x", "y").mapInArrow(run, _ALIKE)


_ALIKE = "left string, right string, similarity double"


def _name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (side, n, name, g) by side and n to _BLOCK; held has the numbers of each name's trigrams among the block's."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        words = rows.column("g").combine_chunks().flatten().dictionary_encode()
        values = [[rows.column("side")[0].as_py()], [rows.column("n")[0].as_py()], [uuid.uuid4().hex]]
        held = np.asarray(words.indices).astype("<i4").tobytes()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.column("name").combine_chunks(), words.dictionary)]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), pa.array(values[1], pa.int32()), pa.array(values[2]), *lists, pa.array([held], pa.binary())], names=["side", "n", "id", "names", "grams", "held"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        key = np.asarray(rows.column("side")).astype(np.int64) << 32 | np.asarray(rows.column("n"))
        starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        for s, e in zip(starts, np.append(starts[1:], len(key))):
            while e - s > NAMES_HELD or s < e < len(key):
                yield made(rows.slice(s, min(e - s, NAMES_HELD)))
                s = min(e, s + NAMES_HELD)
            rest = rows.slice(s)  # it may go on in the next batch
    if rest is not None:
        yield made(rest)


def _alike(x: pa.StructScalar, y: pa.StructScalar, least: float, within: bool, same: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks that are alike; within one side by name, of one block with itself each pair once."""
    n, m = x["n"].as_py(), y["n"].as_py()
    need = next((c for c in range(min(n, m) + 1) if c / (n + m - c) >= least - 1e-12), None)
    if need is None:
        return
    names = [x["names"].values, y["names"].values]
    mine, theirs = x["grams"].values, y["grams"].values
    # Trigrams by their number in x; those that the other block lacks are -1.
    at = np.asarray(pc.fill_null(pc.index_in(mine, value_set=theirs), -1)).astype(np.int64)
    back = np.full(len(theirs), -1)
    back[at[at >= 0]] = np.flatnonzero(at >= 0)
    a, b = (np.frombuffer(z["held"].as_buffer(), "<i4").reshape(-1, k) for z, k in ((x, n), (y, m)))
    a, b = np.where(at[a] >= 0, a, -1), back[b]
    row, col = (np.flatnonzero((z >= 0).sum(1) >= need) for z in (a, b))
    if not len(row) or not len(col):
        return

    def postings(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of z by trigram, where each trigram's begin)."""
        flat = z.ravel()
        order = np.argsort(flat, kind="stable")
        return order // z.shape[1], np.searchsorted(flat[order], np.arange(len(mine) + 1))

    kind = np.uint8 if min(n, m) < 256 else np.uint32
    cols, begin = postings(b[col])
    for s in range(0, len(row), NAMES_COUNTED):
        part = row[s : s + NAMES_COUNTED]
        rows, first = postings(a[part])
        shared, of_col, of_row = np.zeros((len(part), len(col)), kind), np.zeros(len(col), kind), np.zeros(len(part), kind)
        for g in np.flatnonzero((np.diff(first) > 0) & (np.diff(begin) > 0)).tolist():
            r, c = rows[first[g] : first[g + 1]], cols[begin[g] : begin[g + 1]]
            if len(r) == len(part):
                of_col[c] += 1
            elif len(c) == len(col):
                of_row[r] += 1
            elif len(c) * 8 > len(col):
                there = np.zeros(len(col), kind)
                there[c] = 1
                shared[r] += there
            else:
                shared[r[:, None], c] += 1
        shared += of_col
        shared += of_row[:, None]
        hits = np.flatnonzero(shared >= need)
        for t in range(0, len(hits), 1 << 16):
            i, j = np.divmod(hits[t : t + (1 << 16)], len(col))
            both = shared[i, j].astype(np.int64)
            one, two = names[0].take(pa.array(part[i])), names[1].take(pa.array(col[j]))
            keep, similarity = pc.not_equal(one, two), pa.array(both / (n + m - both))
            if same:
                keep = pa.array(part[i] < col[j])
            if within:
                turned = pc.greater(one, two)
                one, two = pc.if_else(turned, two, one), pc.if_else(turned, one, two)
            yield pa.RecordBatch.from_arrays([one, two, similarity], names=["left", "right", "similarity"]).filter(keep)


def log_idf(n_docs: int, df: int) -> float:
    return math.log((n_docs + 1) / (df + 1)) + 1
