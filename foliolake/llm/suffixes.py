"""Repeated passages by a depth-limited radix sort of suffixes: what also stands earlier in the corpus is removed.

Suffixes are ordered through their first `threshold` bytes only, so a group of equal ones is a repeated window.
Digits are taken from the most significant on, and a suffix that is alone in its group falls out:

1. The first digit of a window is its least `gram`: of all runs of so many bytes inside it the one with the least
   hash, the leftmost of those.  Equal windows have equal ones at equal places.  Neighbouring windows mostly share
   theirs, so one row stands for a run of windows (about 25 of them at 100 bytes) and texts are never expanded.
2. Runs that are equal as a whole, by 112 bits of digests, are settled at once: all but the earliest repeat it.
   This is done inside each chunk of texts before anything is sent, and then by bucket of the first digit.
3. Other runs of one first digit go on if they share the next digit, the bytes to its left or to its right.
4. Those fetch their bytes, and the windows inside are sorted by digits of eight bytes through the threshold.

A first digit that very many different runs share is no bucket of its own: its windows are sent one by one, each under
the digest of all its bytes, where copies collapse inside each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .staging import parts_of, release, stage, stage_mapped
from .worker import enter

THRESHOLD, GRAM = 100, 50
#: Bytes of texts that one chunk gathers (a longer text stands alone) and whose windows one numpy pass sees.
CHUNK, BLOCK = 24 << 20, 1 << 19
#: Text bytes to a bucket, and least buckets.
BUCKET, BUCKETS = 16 << 20, 1024
#: A first digit is hot beyond so many runs, or this share of all runs: the hot ones are at most SHARE in number.
HOT, SHARE = 512, 4_000_000
#: Pieces sorted together; a first digit's pieces are never parted.
PIECES = 20_000

U64 = np.uint64
_UP, _DOWN = tb._powers(1 << 20)
_VALUE = tb.seeded(41, 256)
_SALT = tb.seeded(42, 8)
_LOW = U64((1 << 20) - 1)
_ENTRY = np.dtype([("k", "<u8"), ("h", "<u8"), ("left", "<u2"), ("right", "<u2"), ("id", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("m", "<i8"), ("o", "<u2")])
_LAST_ID = (1 << 63) - 1
_FOUND = "open boolean, id long, tie long, start long, m long, o long, k long"


def _digest(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the bytes from first to last, wherever they stand."""
    return tb.mix((sums[last] - sums[first]) * _DOWN[first] + _SALT[0] * (last - first).astype(U64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n]) if size < width else out


def runs_of_windows(raw: np.ndarray, at: np.ndarray, threshold: int, gram: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries) of the windows of raw, whose rows are borders at: entries' start counts from their row's begin.

    An entry stands for windows start .. start + m - 1 with the same least gram, o bytes after the first one's start.
    Runs are cut at the edges of a pass, so that equal runs may be cut differently: they meet again by their gram.
    """
    half, long = (threshold - gram) // 2, np.diff(at) >= threshold
    if not long.any():
        return
    for s in range(0, int(at[-1]), BLOCK):
        part = raw[s : s + BLOCK + threshold - 1]
        n = len(part) - threshold + 1
        if n <= 0:
            continue
        r0, r1 = int(np.searchsorted(at, s, "right")) - 1, int(np.searchsorted(at, s + n, "left"))
        if not long[r0:r1].any():
            continue
        inside = np.minimum(at[r0 + 1 : r1 + 1], s + n) - np.maximum(at[r0:r1], s)
        ends = np.repeat(at[r0 + 1 : r1 + 1], inside)
        p = np.flatnonzero(ends - s - np.arange(n) >= threshold)
        if not len(p):
            continue
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_VALUE[part] * _UP[: len(part)], dtype=U64, out=sums[1:])
            every = np.arange(len(part) - gram + 1)
            grams = _digest(sums, every, every + gram)
            where = (_least((grams & ~_LOW) | every.astype(U64), threshold - gram + 1) & _LOW).astype(np.int64)[p]
            opens = np.ones(len(p), bool)
            opens[1:] = (where[1:] != where[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(opens)
            m = np.diff(np.append(first, len(p)))
            where, first = where[first], p[first]
            k = grams[where]
            if len(hot) and (far := np.isin(k, hot)).any():
                lone = np.repeat(first[far], m[far]) + tb._ranges(m[far])
                of = np.repeat(where[far], m[far])
                alone = np.zeros(len(lone), _ENTRY)
                alone["k"] = tb.mix(_digest(sums, lone, lone + threshold) + _SALT[1])
                alone["h"], alone["m"] = tb.mix(grams[of] + _SALT[2] * (of - lone).astype(U64)), 1
                yield _placed(alone, lone + s, at)
                k, first, where, m = k[~far], first[~far], where[~far], m[~far]
            out = np.zeros(len(k), _ENTRY)
            o = where - first
            out["k"], out["m"], out["o"] = k, m, o
            out["h"] = tb.mix(_digest(sums, first, first + m - 1 + threshold) + _SALT[3] * o.astype(U64)) & ~U64(0xFFFF)
            has = o >= half
            out["left"][has] = 1 + _digest(sums, where[has] - half, where[has]) % U64(0xFFFF)
            has = threshold - gram - (o - m + 1) >= half
            out["right"][has] = 1 + _digest(sums, where[has] + gram, where[has] + gram + half) % U64(0xFFFF)
        yield _placed(out, first + s, at)


def _placed(entries: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.searchsorted(at, start, "right") - 1
    entries["start"] = start - at[rows]
    return rows, entries


def _chunks(batches, threshold: int, gram: int, hot: np.ndarray) -> Iterator[np.ndarray]:
    """Entries of about CHUNK bytes of texts(id, tie, text) at a time."""
    held, size = [], 0
    for batch in batches:
        ids, ties = (np.asarray(batch.column(k)) for k in (0, 1))
        at, raw, _ = tb.buffers(batch.column(2))
        for a, b in tb.chunks(at, CHUNK):
            if held and size + at[b] - at[a] > CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
            for rows, entries in runs_of_windows(raw[at[a] : at[b]], at[a : b + 1] - at[a], threshold, gram, hot):
                entries["id"], entries["tie"] = ids[a:b][rows], ties[a:b][rows]
                held.append(entries)
            size += int(at[b] - at[a])
    if held:
        yield np.concatenate(held)


def _in_order(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by digits, then by place; and which of them is the earliest of its digits (all rows of one place are)."""
    e = entries[np.lexsort((entries["start"], entries["tie"], entries["id"], entries["h"], entries["k"]))]
    if not len(e):
        return e, np.zeros(0, bool)
    opens = np.ones(len(e), bool)
    opens[1:] = (e["k"][1:] != e["k"][:-1]) | (e["h"][1:] != e["h"][:-1])
    lead = e[np.maximum.accumulate(np.where(opens, np.arange(len(e)), 0))]
    return e, (e["id"] == lead["id"]) & (e["tie"] == lead["tie"]) & (e["start"] == lead["start"])


def _packed(entries: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(entries).view(np.uint8).reshape(-1, _ENTRY.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(_ENTRY.itemsize, -1).T).view(_ENTRY).ravel()


def _joined(e: np.ndarray) -> np.ndarray:
    """Entries whose windows touch, of one document, as one."""
    e = np.sort(e, order=("id", "tie", "start"))
    if not len(e):
        return e
    end = e["start"] + e["m"]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e["id"][1:] != e["id"][:-1]) | (e["tie"][1:] != e["tie"][:-1]) | (e["start"][1:] > end[:-1])
    at = np.flatnonzero(fresh)
    out = e[at]
    out["m"] = np.maximum.reduceat(end, at) - out["start"]
    return out


def _sent(threshold: int, gram: int, bits: int, hot: np.ndarray):
    """Texts to (bucket, repeated, entries): by first digit what is the earliest in its chunk, and what repeats that."""

    def run(batches):
        enter("suffixes")
        for entries in _chunks(batches, threshold, gram, hot):
            e, first = _in_order(entries)
            again, e = _joined(e[~first]), e[first]
            rows = [(int(again["id"][0]) & ((1 << bits) - 1), True, _packed(again))] if len(again) else []
            bucket = (e["k"] >> U64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows += [(int(bucket[a]), False, _packed(e[a:b])) for a, b in zip(at, [*at[1:], len(e)])]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 256]), (pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "repeated", "entries"])

    return run


def _found(e: np.ndarray, opened: bool) -> pa.Table:
    columns = [pa.array(np.full(len(e), opened))] + [pa.array(e[c].astype(np.int64)) for c in ("id", "tie", "start", "m", "o")] + [pa.array(e["k"].view(np.int64))]
    return pa.table(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def _settle(table: pa.Table) -> pa.Table:
    """One bucket: runs that repeat an earlier one, and runs that go on (open)."""
    enter("suffixes")
    again = np.asarray(table.column("repeated"))
    parts = [_unpacked(x) for x in table.column("entries").to_pylist()]
    known = np.concatenate([np.zeros(0, _ENTRY), *[x for x, r in zip(parts, again) if r]])
    e, first = _in_order(np.concatenate([np.zeros(0, _ENTRY), *[x for x, r in zip(parts, again) if not r]]))
    reps = e[first]
    digit = np.cumsum(np.diff(reps["k"], prepend=reps["k"][:1]) != 0)
    goes_on = np.zeros(len(reps), bool)
    for side in ("left", "right"):
        has = np.flatnonzero(reps[side])
        _, place, n = np.unique(digit[has] << 16 | reps[side][has], return_inverse=True, return_counts=True)
        goes_on[has] |= n[place] > 1
    return pa.concat_tables([_found(_joined(np.concatenate([known, e[~first]])), False), _found(reps[goes_on], True)])


def _hot_digits(texts: DataFrame, threshold: int, gram: int, hot: int, share: int) -> tuple[np.ndarray, int]:
    """First digits that more than `hot` different runs share, and the bytes of all texts.

    A chunk reports the digits that several of its own runs share.  At most `share` digits are hot.
    """

    def run(batches):
        enter("suffixes")
        for entries in _chunks(batches, threshold, gram, np.zeros(0, U64)):
            e = entries[["k", "h"]][np.lexsort((entries["h"], entries["k"]))]
            k = e["k"][np.concatenate([[True], (e["k"][1:] != e["k"][:-1]) | (e["h"][1:] != e["h"][:-1])])]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.append(at, len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(k[at[n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["k", "n"])

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= hot * (threshold - gram) // 2:
        return np.zeros(0, U64), size
    least = max(hot, 2 * size // (threshold - gram) // share)
    shared = stage(texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least), "hot_digits")
    found = np.array([r["k"] for r in shared.select("k").toLocalIterator()], np.int64).view(U64)
    release(shared)
    return np.sort(found), size


def _pieces(threshold: int):
    """Texts and what they are asked for to the bytes of each run."""

    def run(batches):
        enter("suffixes")
        for batch in parts_of(batches, 256):
            rows = []
            for i, tie, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_buffer()
                rows += [(a["k"], i, tie, a["start"], a["m"], raw[a["start"] : a["start"] + a["m"] - 1 + threshold].to_pybytes()) for a in asked]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 4096]), [pa.int64()] * 5 + [pa.binary()])], names=["k", "id", "tie", "start", "m", "raw"])

    return run


def equal_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, groups): places in raw, of those given by at, whose next `threshold` bytes equal others' of their group.

    A most significant digit radix sort: eight bytes a pass, and what is alone after a pass is not looked at again.
    """
    wide = np.zeros(len(raw), U64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    for j in range(8):
        wide |= padded[j : j + len(raw)].astype(U64) << U64(56 - 8 * j)
    alive = np.arange(len(at))
    for d in range(0, threshold, 8):
        digit = wide[at[alive] + d] >> U64(8 * max(0, d + 8 - threshold))
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        opens = np.ones(len(alive), bool)
        opens[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(opens)
        several = np.bincount(group)[group] > 1
        alive, group = alive[several], group[several]
        if not len(alive):
            break
    return alive, group


def _sorted_through(threshold: int):
    """Pieces by first digit to the runs of windows in them that stand earlier elsewhere."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        k, ids, ties, start, m = (np.asarray(t.column(c).combine_chunks()) for c in ("k", "id", "tie", "start", "m"))
        at, raw, _ = tb.buffers(t.column("raw"))
        of, inside = np.repeat(np.arange(len(k)), m), tb._ranges(m)
        alive, group = equal_windows(raw, at[of] + inside, np.unique(k, return_inverse=True)[1][of], threshold)
        of, place = of[alive], start[of[alive]] + inside[alive]
        order = np.lexsort((place, ties[of], ids[of], group))
        of, place, group = of[order], place[order], group[order]
        opens = np.flatnonzero(np.diff(group, prepend=-1))
        lead = np.repeat(opens, np.diff(np.append(opens, len(group))))
        later = (ids[of] != ids[of[lead]]) | (ties[of] != ties[of[lead]]) | (place != place[lead])
        out = np.zeros(int(later.sum()), _ENTRY)
        out["id"], out["tie"], out["start"], out["m"] = ids[of[later]], ties[of[later]], place[later], 1
        out = _joined(out)
        return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("id", "tie", "start", "m")], names=["id", "tie", "start", "m"])

    def run(batches):
        enter("suffixes")
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= PIECES:
                t = pa.Table.from_batches(held)
                k = np.asarray(t.column("k").combine_chunks())
                cut = int(np.searchsorted(k, k[-1]))  # the last digit's pieces may go on
                if cut:
                    yield settle(t.slice(0, cut).combine_chunks())
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with (id, tie), their order: null ids last, a repeated id by a hash of its texts."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(_LAST_ID)))
    repeated = keyed.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("id") == _LAST_ID)).select("id", F.lit(True).alias("again"))
    several = stage(repeated, "repeated_ids")
    if several.isEmpty():
        return keyed.select("doc_id", "id", F.lit(0).cast("long").alias("tie"), "text")
    return keyed.join(several, "id", "left").select("doc_id", "id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("tie"), "text")


def _cut(threshold: int):
    def run(batches):
        for batch in parts_of(batches, 256):
            rows = []
            for i, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                for r in runs or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["m"] - 1 + threshold] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                rows.append((i, len(raw), int(gone.sum()), [{"start": a, "length": b - a} for a, b in edges.tolist()], raw[~gone].tobytes()))
            types = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<(start, length)>, kept binary) for each row of docs(doc_id, text, ...).

    Texts are their UTF-8 bytes.  A byte goes if it lies in a run of `threshold` bytes that also starts earlier, in a
    document of a smaller doc_id or further on the left in its own; runs never cross documents and are judged on the
    whole input.  spans are the maximal runs of bytes that go.

    A null text is empty; documents shorter than the threshold stay as they are.  Null doc_ids come after all others;
    rows that share a doc_id are ordered by a hash of their texts, and rows that repeat a doc_id with its text are one
    document: each gets that document's result.  Other columns are not read; an empty table gives no rows.
    """
    if not 8 <= gram < threshold:
        raise ValueError("gram must be at least 8 and below threshold")
    texts = _numbered(docs)
    three = texts.select("id", "tie", "text")
    many, size = _hot_digits(three, threshold, gram, hot, share)
    bits = max(BUCKETS, size // BUCKET).bit_length() - 1
    sent = three.mapInArrow(_sent(threshold, gram, bits, many), "bucket long, repeated boolean, entries binary")
    found = stage_mapped(sent.groupBy("bucket").applyInArrow(_settle, _FOUND), "found")
    asked = found.where("open").groupBy("id", "tie").agg(F.collect_list(F.struct("k", "start", "m")).alias("asked"))
    pieces = three.join(asked, ["id", "tie"]).select("id", "tie", "text", "asked").mapInArrow(_pieces(threshold), "k long, id long, tie long, start long, m long, raw binary")
    wide = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.where("open").count() // (8 * PIECES))
    later = stage_mapped(pieces.repartition(wide, "k").sortWithinPartitions("k").mapInArrow(_sorted_through(threshold), "id long, tie long, start long, m long"), "later")
    runs = found.where("not open").select("id", "tie", "start", "m").unionByName(later).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "m")).alias("runs"))
    return texts.join(runs, ["id", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(_cut(threshold), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary")
