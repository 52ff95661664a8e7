"""Phrases that hold together: words that stand side by side more often than their parts alone would have it.

Documents are gathered into shards of one language.  Each shard becomes a generalised suffix automaton of its pieces,
bounded in depth: its states are sets of end positions, a state stands for all its substrings (the longest and the
suffixes that occur nowhere else), and its suffix link is the longest suffix that does.  The automaton enumerates
its substrings with their numbers of end positions; buckets of substrings add these up over shards.  What is frequent
in all is spelt out again by one of the shards that hold it, which also names, by suffix link and prefix, the
substrings one word shorter inside it; those decide what is subsumed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .staging import release, stage, stage_mapped
from .worker import enter

DEPTH, LEAST, INSIDE, BEST = 3, 10, 50, 2000
#: Words of a shard at most (a longer text stands alone), and that a task holds of all languages together.
SHARD, HELD = 1_200_000, 2_000_000
#: Words of the corpus to a bucket, and least buckets.
BUCKET, BUCKETS = 1 << 20, 1024

U64 = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_ODD = tb.seeded(51, 16) | U64(1)
_UNKNOWN = "und"
_SHARDS = "shard long, lang string, n_words long, places binary, opens binary, words binary, ends binary"


def _zip(x: np.ndarray | bytes) -> bytes:
    """Whole numbers byte by byte of all of them, or bytes as they are, compressed."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(data: bytes, kind: str | None = None) -> np.ndarray | bytes:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    if kind is None:
        return raw
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, opens) of the words of raw with row borders at; opens: the first word of a piece."""
    solid = _SOLID[raw]
    if not solid.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    before = np.concatenate([[False], solid[:-1]]) & ~border[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~border[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    broken = np.cumsum(np.concatenate([[0], _BREAK[raw]]))
    rows = np.searchsorted(at, starts, "right")
    opens = np.ones(len(starts), bool)
    opens[1:] = (broken[starts[1:]] != broken[ends[:-1]]) | (rows[1:] != rows[:-1])
    return starts, ends, opens


class Automaton:
    """The generalised suffix automaton of pieces of words, for substrings of at most `depth` words.

    places: the word numbers, piece after piece; opens: where a piece begins.  Substrings are numbered by length: those
    of length k from base[k - 1] on.  For each: count (its end positions), end (one of them), suffix (the substring
    without its first word, -1 for single words), state.  For each state: longest, shortest (lengths), size (end
    positions), link (the state of the longest suffix that also ends elsewhere; -1: the empty one).
    """

    def __init__(self, places: np.ndarray, opens: np.ndarray, depth: int = DEPTH):
        n_words = int(places.max()) + 1 if len(places) else 0
        self.places = places
        self.base, count, end, suffix = [0], [], [], []
        # From here on a place's own substring of each length; -1 where its piece is too short.
        own, room = places.astype(np.int64), np.ones(len(places), bool)
        for k in range(depth):
            if k == 1:
                room = ~opens
            elif k:
                room = room & np.concatenate([[False], room])[:-1]
            at = np.flatnonzero(room)
            key = places[at].astype(np.int64) if not k else own[at - 1] * n_words + places[at]
            _, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            del key
            count.append(n.astype(np.int32))
            end.append(at[first].astype(np.int32))
            suffix.append((own[at[first]] + self.base[k - 1] if k else np.full(len(n), -1)).astype(np.int32))
            self.base.append(self.base[-1] + len(n))
            own = np.full(len(places), -1)
            own[at] = number
        del own, room
        self.count, self.end, self.suffix = (np.concatenate(x) for x in (count, end, suffix))
        self.length = np.repeat(np.arange(1, depth + 1, dtype=np.int8), np.diff(self.base))
        # A substring with as many end positions as its suffix has the same ones: one state.
        same = np.flatnonzero((self.suffix >= 0) & (self.count == self.count[self.suffix]))
        longer = np.arange(len(self.count), dtype=np.int32)
        for lo, hi in reversed(list(zip(self.base, self.base[1:]))):
            here = same[(same >= lo) & (same < hi)]
            longer[self.suffix[here]] = longer[here]
        tops, self.state = np.unique(longer, return_inverse=True)
        self.longest, self.size = self.length[tops], self.count[tops]
        bottom = np.setdiff1d(np.arange(len(self.count)), same, assume_unique=True)  # the shortest of each state
        self.shortest, self.link = np.zeros(len(tops), np.int64), np.full(len(tops), -1)
        self.shortest[self.state[bottom]] = self.length[bottom]
        linked = bottom[self.suffix[bottom] >= 0]
        self.link[self.state[linked]] = self.state[self.suffix[linked]]

    def substrings(self) -> tuple[np.ndarray, np.ndarray]:
        """Every substring's number and its number of end positions, state by state."""
        return np.arange(len(self.state)), self.size[self.state]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key of each substring, made of its words' hashes and its length."""
        out = np.empty(len(self.count), U64)
        with np.errstate(over="ignore"):
            for k, (lo, hi) in enumerate(zip(self.base, self.base[1:])):
                total = np.full(hi - lo, _ODD[15] * U64(k + 1), U64)
                for j in range(k + 1):
                    total = tb.mix(total + hashes[self.places[self.end[lo:hi] - j]] * _ODD[j])
                out[lo:hi] = total
        return out


def shards(docs: DataFrame) -> DataFrame:
    """Staged shards of docs(lang, text): places of word numbers, where pieces open, and the words."""

    def closed(number: int, lang: str, held: list, known: dict[int, bytes]) -> pa.RecordBatch:
        hashes, opens = (np.concatenate(x) for x in zip(*held))
        distinct, places, n = np.unique(hashes, return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")  # frequent words get the small numbers, which pack best
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        words = [known[h] for h in distinct[often].tolist()]
        row = [number, lang, len(hashes), _zip(rank[places].astype("<u4")), _zip(np.packbits(opens).tobytes()), _zip(b"".join(words)), _zip(np.cumsum([len(w) for w in words]).astype("<i8"))]
        types = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in _SHARDS.split(", ")])

    def run(batches):
        enter("collocations: shards")
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        known: dict[str, dict[int, bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = np.array([x if x is not None else _UNKNOWN for x in batch.column(0).to_pylist()], dtype=object)
            for lang in dict.fromkeys(langs):
                texts = batch.column(1).filter(pa.array(langs == lang))
                at, raw, _ = tb.buffers(texts)
                for a, b in tb.chunks(at):
                    part = raw[at[a] : at[b]]
                    starts, ends, opens = words_of(part, at[a : b + 1] - at[a])
                    if not len(starts):
                        continue
                    if lang in held and size[lang] + len(starts) > SHARD:
                        yield closed(number, lang, held.pop(lang), known.pop(lang))
                        number += 1
                    while held and sum(size[x] for x in held) + len(starts) > HELD:
                        most = max(held, key=size.get)
                        yield closed(number, most, held.pop(most), known.pop(most))
                        number += 1
                    hashes = tb._hash_words(part, starts, ends)
                    if lang not in held:
                        held[lang], known[lang], size[lang] = [], {}, 0
                    distinct, first = np.unique(hashes, return_index=True)
                    own, lower = known[lang], tb._LOWER[part].tobytes()
                    own |= {h: lower[s:e] for h, s, e in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist()) if h not in own}
                    held[lang].append((hashes, opens))
                    size[lang] += len(starts)
        for lang in list(held):
            yield closed(number, lang, held.pop(lang), known.pop(lang))
            number += 1

    return stage_mapped(docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _SHARDS), "shards")


def _opened(row: dict, depth: int) -> tuple[Automaton, list[bytes], np.ndarray]:
    """A shard's automaton, its words, and two hashes of each: to tell substrings apart, and to deal them."""
    places, raw, ends = _unzip(row["places"], "<u4"), _unzip(row["words"]), _unzip(row["ends"], "<i8").tolist()
    opens = np.unpackbits(np.frombuffer(_unzip(row["opens"]), np.uint8), count=len(places)).astype(bool)
    words = [raw[s:e] for s, e in zip([0, *ends], ends)]
    tongue = row["lang"].encode()[:64] + hashlib.blake2b(row["lang"].encode(), digest_size=8).digest()
    digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16, key=tongue[-64:]).digest() for w in words), "<u8").reshape(-1, 2)
    return Automaton(places, opens, depth), words, digests


def _counted(depth: int, bits: int):
    """Shards to (bucket, shard, keys, counts) of all their substrings."""

    def run(batches):
        enter("collocations: automata")
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                automaton, _, digests = _opened(row, depth)
                number, n = automaton.substrings()
                bucket = (automaton.keys(digests[:, 1])[number] >> U64(64 - bits)).astype(np.int32)
                sent = automaton.keys(digests[:, 0])[number]
                del automaton, number, digests
                order = np.lexsort((sent, bucket))
                bucket, sent, n = bucket[order], sent[order], n[order].astype("<u4")
                del order
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = [(int(bucket[a]), row["shard"], _zip(sent[a:b]), _zip(n[a:b])) for a, b in zip(at, [*at[1:], len(sent)])]
                for r in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[r : r + 256]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "shard", "keys", "counts"])

    return run


def _frequent(least: int):
    """One bucket to (shard, keys, totals): substrings at least so frequent in all, each at one shard that holds it."""

    def run(table: pa.Table) -> pa.Table:
        enter("collocations: sums")
        parts = [_unzip(x, "<u8") for x in table.column("keys").to_pylist()]
        every = np.concatenate(parts)
        where = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        n = np.concatenate([_unzip(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        every, where, n = every[order], where[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total, holders = np.add.reduceat(n, at), np.diff(np.append(at, len(every)))
        # Any of the holders may be asked; a frequent phrase has many, so they are asked in turn.
        asked = where[at + (every[at] % holders.astype(U64)).astype(np.int64)]
        often = np.flatnonzero(total >= least)
        often = often[np.argsort(asked[often], kind="stable")]
        cut = np.flatnonzero(np.diff(asked[often], prepend=-1))
        shard = np.asarray(table.column("shard").combine_chunks())
        rows = [(int(shard[asked[often[a]]]), _zip(every[at][often[a:b]]), _zip(total[often[a:b]])) for a, b in zip(cut, [*cut[1:], len(often)])]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "totals"])

    return run


_SPELT = "lang string, words array<string>, inside array<string>, n long"


def _spelt(depth: int):
    """Shards and what they are asked for to (lang, words, inside, n); inside: phrases one word shorter, by prefix and link."""

    def run(batches):
        enter("collocations: words")
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                automaton, words, digests = _opened(row, depth)
                keys, text = automaton.keys(digests[:, 0]), [w.decode() for w in words]
                order = np.argsort(keys)
                wanted = np.concatenate([_unzip(a["keys"], "<u8") for a in row["asked"]])
                total = np.concatenate([_unzip(a["totals"], "<i8") for a in row["asked"]])
                found = order[np.searchsorted(keys[order], wanted)]

                def spell(subs: np.ndarray) -> list[list[str]]:
                    return [[text[w] for w in automaton.places[e - n + 1 : e + 1].tolist()] for e, n in zip(automaton.end[subs].tolist(), automaton.length[subs].tolist())]

                for a in range(0, len(found), 1 << 14):
                    subs = found[a : a + (1 << 14)]
                    phrases = spell(subs)
                    shorter = [[" ".join(p[:-1]), " ".join(s)] if len(p) > 2 else [] for p, s in zip(phrases, spell(np.maximum(automaton.suffix[subs], 0)))]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(subs)), pa.array(phrases, pa.list_(pa.string())), pa.array(shorter, pa.list_(pa.string())), pa.array(total[a : a + (1 << 14)])], names=[c.split()[0] for c in _SPELT.split(", ")])

    return run


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Staged (lang, words, inside, n) of all phrases of up to `depth` words that occur `least` times, and (lang, n)."""
    parts = shards(docs)
    sizes = stage(parts.groupBy("lang").agg(F.sum("n_words").alias("n")), "sizes")
    bits = max(BUCKETS, (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET).bit_length() - 1
    sent = parts.mapInArrow(_counted(depth, bits), "bucket long, shard long, keys binary, counts binary")
    often = stage_mapped(sent.groupBy("bucket").applyInArrow(_frequent(least), "shard long, keys binary, totals binary"), "often")
    asked = often.groupBy("shard").agg(F.collect_list(F.struct("keys", "totals")).alias("asked"))
    spelt = stage_mapped(parts.join(asked, "shard").mapInArrow(_spelt(depth), _SPELT), "spelt")
    release(parts, often)
    return spelt, sizes


def exact_score() -> Column:
    """floor(1000000 * a * a / (l * r)) of columns a, l and r, whose products pass 64 bits."""
    whole = lambda c: f"cast({c} as decimal(14, 0))"
    return F.expr(f"(1000000 * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")


def _ranked(rows: DataFrame, by: list[str], order: list, best: int) -> DataFrame:
    """rows, each group's first `best` in order, with their rank: sorted by ranges, ranks by prefix sums over ranges."""
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition's number, and the row's inside it
    dealt = rows.repartitionByRange(wide, *by, *order).sortWithinPartitions(*by, *order).withColumn("place", place)
    spread = stage(dealt.withColumn("part", F.shiftright("place", 33)), "ranked")
    runs = spread.groupBy(*by, "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each group and range that meet: ranges and groups together bound them.
    runs = runs.select(*by, "part", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before")).where(F.col("before") < best)
    ranked = spread.join(F.broadcast(runs), [*by, "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first") + 1)
    return ranked.where(F.col("rank") <= best).drop("part", "place", "first", "before")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, inside: int = INSIDE, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of docs(lang, text, ...) that hold together best.

    Pieces end at .,;:!? and line breaks; words are what blanks and tabs part, A-Z lower-cased.  A phrase of 2 to `depth`
    words that occurs a >= `least` times in its language is scored by its weakest cut: floor(1000000 * a * a / (l * r)) for
    l and r occurrences of its two parts, exact to counts of 14 digits (beyond, Spark raises).  It is dropped if a longer
    phrase that holds it has at least `inside` percent of a.  Of each language the `best` by score, a, and phrase.

    A null lang is 'und', a null or empty text has no words; repeated rows count as often as they come; doc_id and other
    columns are not read; an empty table gives no rows.  Substrings are told apart by 64 bits of digests within buckets
    dealt by 64 others.
    """
    spelt, sizes = frequent_phrases(docs, depth, least)
    phrases = spelt.select("lang", F.array_join("words", " ").alias("phrase"), "n")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("right"))))
    longer = spelt.where(F.size("words") > 1)
    cuts = longer.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), cut.alias("k", "cut")).select("lang", "phrase", "a", "k", "cut.left", "cut.right")
    parts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    weakest = parts.groupBy("lang", "phrase").agg(F.min(F.struct(exact_score().alias("score"), "k", "l", "r", "a")).alias("w")).select("lang", "phrase", "w.*")
    holding = longer.select("lang", F.explode("inside").alias("phrase"), F.col("n").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    left = weakest.join(holding, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("held") < inside * F.col("a"), F.lit(True)))
    scored = stage(left.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score"), "scored")
    out = stage(_ranked(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], best), "collocations")
    release(spelt, sizes, scored)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
