"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: case, look-alike letters of other scripts, digits and signs that stand for letters.
A match must begin at the start of a word; entries are whole words or stems, and exception phrases cancel
what lies inside them.  The lexicon and its weights are learnt from labelled texts: log ratios of how often
an entry occurs per word in toxic and in clean ones.  Exceptions are learnt too: two words one of which is
telling by itself, while both together are found in clean texts; what they explain no longer counts against
the word.  A logistic curve over three length-normalised sums gives the score: matched weight for the
text's length, the same with a thousand characters more, so that little evidence in a short text counts
less, and matched weight in the densest stretch of fixed length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import parts_of, release, stage
from .worker import enter

THRESHOLD = 0.3
#: Labelled rows that are learnt from, at most, of each class: those with the least hashes of their ids.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 12_000
STEMS = range(4, 9)
#: An entry is in so many toxic texts at least, and this much likelier in them (log); the fewer texts hold it
#: the more, by FEW divided by their number.
LEAST_TEXTS, LEAST_WEIGHT, FEW = 3, 2.0, 4.0
#: Texts whose entries are counted together before they are sent.
TOGETHER = 512
#: A text that repeats an entry may raise its weight by this much over what numbers of texts alone say.
REPEATED = 1.5
#: A word may have exceptions from this weight on: without what they explain it may tell enough.
HALF_TELLING = 1.0
#: Characters of the stretch in which the densest matches are summed.
STRETCH = 400

# Letters of other scripts, digits and signs that pass for Latin letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l",
}
_FOLD = {ord(k): v for k, v in _ALIKE.items()} | {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_UNSEEN = re.compile("[​‌‍⁠﻿­]")
_WORD = re.compile(r"[^\W\d_](?:[^\s.,;:?|#%&*()\[\]{}\"<>=+/\\]*[^\W_])?")


def fold(text: str) -> tuple[str, str]:
    """(plain, folded): of one length, so that a place in one is the same place in the other."""
    plain = text.lower() if text.isascii() else _UNSEEN.sub("", text).lower()
    return plain, plain.translate(_FOLD)


def _places(text: str) -> list[tuple[str, bool]]:
    """Folded words of a text in order, and whether one blank alone is between each and the word before."""
    plain, folded = fold(text)
    out, last = [], -1
    for m in _WORD.finditer(plain):
        out.append((folded[m.start() : m.end()], m.start() == last + 1 and plain[last] == " "))
        last = m.end()
    return out


def _words(text: str, exceptions: frozenset[str] = frozenset()) -> Counter:
    """Folded words of a text, without those inside an exception."""
    words = _places(text)
    if not exceptions:
        return Counter(w for w, _ in words)
    out = Counter()
    for k, (w, beside) in enumerate(words):
        before = beside and f"{words[k - 1][0]} {w}" in exceptions
        after = k + 1 < len(words) and words[k + 1][1] and f"{w} {words[k + 1][0]}" in exceptions
        if not before and not after:
            out[w] += 1
    return out


def _entries(word: str):
    """What a word could be matched by: `word$` whole, or a stem it begins with."""
    for n in STEMS:
        if len(word) >= n:
            yield word[:n]
    yield word + "$"


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()

    def automaton(self):
        import ahocorasick

        if not hasattr(self, "_automaton"):
            found: dict[str, list] = {}
            for entry, weight in self.weights.items():
                found.setdefault(entry.rstrip("$"), []).append((entry.endswith("$"), weight))
            for phrase in self.exceptions:
                found.setdefault(phrase.lower().translate(_FOLD), []).append((False, None))
            built = ahocorasick.Automaton()
            for key, values in found.items():
                built.add_word(key, (len(key), values))
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def matched(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the longest entry at each word that has one, exceptions applied."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        plain, folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        spared = []
        words: set[tuple[int, int]] | None = None
        for end, (n, values) in automaton.iter(folded):
            start, end = end - n + 1, end + 1
            if start and plain[start - 1].isalpha():
                continue
            closed = end == len(plain) or not plain[end].isalpha()
            for whole, weight in values:
                if weight is None:
                    if closed:
                        spared.append((start, end))
                elif (closed or not whole) and (start not in best or end >= best[start][0]):
                    if n < STEMS.start:  # too short to stand for a word by its letters alone: not the re of you're
                        words = words or {m.span() for m in _WORD.finditer(plain)}
                        if (start, end) not in words:
                            continue
                    best[start] = (end, weight)
        spared.sort()
        starts, ends = [a for a, _ in spared], [-1, *accumulate((b for _, b in spared), max)]
        return [(s, e, w) for s, (e, w) in sorted(best.items()) if ends[bisect_right(starts, s)] < e]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Three sums over the matches, each for a length; without matches all are 0."""
        hits = self.matched(text or "")
        if not hits:
            return 0.0, 0.0, 0.0
        size, first, inside, densest = len(text), 0, 0.0, 0.0
        for s, e, w in hits:
            inside += w
            while e - hits[first][0] > STRETCH and hits[first][0] < s:
                inside -= hits[first][2]
                first += 1
            densest = max(densest, inside)
        total = sum(w for _, _, w in hits)
        return math.log1p(1000 * total / (size + 100)), math.log1p(1000 * total / (size + 1000)), math.log1p(1000 * densest / (min(size, STRETCH) + 100))

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method, the bias not penalised."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return (float(w[0] - (slopes * mean).sum()), *map(float, slopes))


def held_out(doc_id: Column) -> Column:
    """Whether a row is left out of learning, by its id's checksum; null for a null id, which has no label either."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, weights and curve from docs(doc_id, text) and labels(doc_id, toxic), held-out rows left out.

    Rows with a null label, id or text teach nothing, nor does an id with two labels; texts that repeat count
    once.  Exceptions are two words with one blank between them.  Without a toxic and a clean row the lexicon is empty and every score the same.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t2")).where("toxic = t2").drop("t2")
    least = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = stage(least(1, TOXIC_ROWS).unionByName(least(0, CLEAN_ROWS)), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # Bounded by TOXIC_ROWS + CLEAN_ROWS.
    sample = stage(texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "labelled")

    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        release(chosen, sample)
        return Lexicon()
    found, half = _evidence(sample, toxic, clean, frozenset())
    exceptions = _exceptions(sample, toxic, clean, half)
    if exceptions:
        found, _ = _evidence(sample, toxic, clean, frozenset(exceptions))
    kept = {e: round(w, 4) for e, w in sorted(_kept(found).items())}
    # Of the exceptions those matter that stand between the lexicon and a text.
    lexicon = Lexicon(kept, exceptions=tuple(p for p in exceptions if any(e in kept for w in p.split(" ") for e in _entries(w))))

    def measured(batches):
        for batch in batches:
            rows = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], names=["toxic", "a", "b", "c"])

    rows = sample.mapInArrow(measured, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])
    lexicon.coefficients = tuple(round(c, 6) for c in _fit(rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy(float)))
    release(chosen, sample)
    return lexicon


def _evidence(sample: DataFrame, toxic: int, clean: int, exceptions: frozenset[str]) -> tuple[dict[str, tuple[float, int, int]], list[str]]:
    """{entry: (weight, occurrences in toxic texts, toxic texts)} of what is telling, and the words that are half telling or more."""
    names = ["entry", "occurs", "inside", "n", "i"]

    def entries(batches):
        enter("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sums: dict[str, list[int]] = {}  # occurrences and texts, toxic then clean; all words under no name
                for text, kind in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = Counter()
                    for word, n in _words(text, exceptions).items():
                        own[""] += n
                        for e in _entries(word):
                            own[e] += n
                    k = 0 if kind else 2
                    for e, n in own.items():
                        x = sums.setdefault(e, [0, 0, 0, 0])
                        x[k] += n
                        x[k + 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([x[k] for x in sums.values()], pa.int64()) for k in range(4)]], names=names)

    per_entry = sample.select("text", "toxic").mapInArrow(entries, "entry string, occurs long, inside long, n long, i long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in names[1:]])
    per_entry = stage(per_entry.where((F.col("inside") >= LEAST_TEXTS) | (F.col("entry") == "")), "entries")
    words = per_entry.where("entry = ''").first()
    clean_words, toxic_words = max(1, words["n"] if words else 0), max(1, words["occurs"] if words else 0)
    # Evidence alone decides what comes to the driver: the same weight as below, with something to spare for rounding.
    by_word = F.log((F.col("occurs") + 0.5) / toxic_words) - F.log((F.col("n") + 2) / clean_words)
    by_text = F.log((F.col("inside") + 0.5) / toxic) - F.log((F.col("i") + 1) / clean)
    weight = F.least(by_word, by_text + REPEATED)
    named = per_entry.where(F.col("entry") != "")
    found = {}
    for e, occurs, inside, n, i in named.where(weight >= LEAST_WEIGHT + FEW / F.col("inside") - 1e-6).select(*names).collect():
        by_word = math.log((occurs + 0.5) / toxic_words) - math.log((n + 2) / clean_words)
        by_text = math.log((inside + 0.5) / toxic) - math.log((i + 1) / clean)
        own = min(by_word, by_text + REPEATED)
        if own >= LEAST_WEIGHT + FEW / inside:
            found[e] = (own, occurs, inside)
    # Only words that clean texts hold as well can have exceptions there.
    half = named.where(F.endswith("entry", F.lit("$")) & (F.col("i") >= LEAST_TEXTS) & (weight >= HALF_TELLING + FEW / F.col("inside"))).select("entry").collect()
    release(per_entry)
    return found, sorted(r["entry"][:-1] for r in half)


def _exceptions(sample: DataFrame, toxic: int, clean: int, words: list[str]) -> list[str]:
    """Pairs of words beside each other, one of them among `words`, that are as likely in clean texts as its evidence asks."""
    if not words:
        return []
    asked = frozenset(words)

    def pairs(batches):
        enter("toxicity")
        for batch in batches:
            inside, i = Counter(), Counter()
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = _places(text)
                own = {f"{a} {b}" for (a, _), (b, beside) in zip(seen, seen[1:]) if beside and (a in asked or b in asked)}
                (inside if kind else i).update(own)
            both = sorted({*inside, *i})
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *[pa.array([c[p] for p in both], pa.int64()) for c in (inside, i)]], names=["pair", "inside", "i"])

    counted = sample.select("text", "toxic").mapInArrow(pairs, "pair string, inside long, i long").groupBy("pair").agg(F.sum("inside").alias("inside"), F.sum("i").alias("i"))
    odds = F.log((F.col("i") + 0.5) / clean) - F.log((F.col("inside") + 0.5) / toxic)
    return sorted(r["pair"] for r in counted.where((F.col("i") >= LEAST_TEXTS) & (odds >= FEW / F.col("i"))).select("pair").collect())


def _kept(found: dict[str, tuple[float, int, int]]) -> dict[str, float]:
    """Of nested entries found in the same places the longest stem; one inside another stays if it says more."""
    weights = {e: min(w, 8.0) for e, (w, _, _) in found.items()}
    occurs_of = {e: occurs for e, (_, occurs, _) in found.items()}
    same: set[str] = set()
    for e in sorted(weights, key=len):
        stem = e.rstrip("$")
        if e.endswith("$"):
            if any(occurs_of.get(stem[:n], 0) and occurs_of[e] >= 0.9 * occurs_of[stem[:n]] for n in STEMS if n <= len(stem)):
                same.add(e)
        else:
            same.update(k for n in STEMS if n < len(e) and (k := e[:n]) in weights and occurs_of[e] >= 0.9 * occurs_of[k])
    kept: dict[str, float] = {}
    for e, weight in sorted(weights.items(), key=lambda x: (len(x[0]), x[0])):
        inner = [k for n in STEMS if n < len(e) and (k := e[:n]) in kept]
        if e not in same and (not inner or weight > max(kept[k] for k in inner) + 1.0):
            kept[e] = weight
    return kept


def scores(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Every row and column of docs with score (0 to 1) and predicted (1: score >= threshold).

    Null and empty texts match nothing and get the score of no match; the whole of any longer text is read.
    Columns named score or predicted are replaced.  Empty table: no rows.
    """
    kept = [f for f in docs.schema if f.name not in ("score", "predicted")]
    inner = docs.select(F.col("text").cast("string").alias("t"), *[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(kept)])
    schema = "score double, " + ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kept))
    broadcast = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        enter("toxicity")
        lex = broadcast.value
        for batch in parts_of(batches):
            values = [lex.score(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), *(batch.column(k) for k in range(1, batch.num_columns))], names=["score", *batch.schema.names[1:]])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(kept)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
