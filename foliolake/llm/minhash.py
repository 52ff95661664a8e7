"""MinHash near-duplicate groups of documents: banding, signature verification, exact confirmation.

1. One pass over the texts makes, per document, the size and a 128-bit key of its shingle set, 128 universal
   hash minima and 32 band keys of four minima each.
2. Documents with equal sets form a class; only its least document goes on, so thousands of exact copies
   count once.
3. A band bucket with several classes elects a centre; distinct (centre, member) pairs are confirmed on full
   sets.  That settles almost every bucket without its pairs ever being written out.
4. What a star cannot settle (members of a bucket that are still apart) is compared tile by tile, signatures
   alone first: members without a partner there that agrees well enough fall out.  Those that are left meet
   again in smaller tiles with their full sets; a pair that agrees in several bands is looked at in the first
   only.  Tiles bound the rows of a task whatever the size of a bucket.
5. Confirmed links become groups by large-star and small-star.

A pair at the threshold 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6 and fails the signature
check (72 of 128 equal minima) with about 2e-6; a link that is found is always confirmed on full sets.
Set elements are 64-bit hashes of five words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import connected_components
from .staging import release, stage, stage_mapped
from .worker import enter

WIDTH, BANDS, ROWS = 5, 32, 4
SIMILAR, OF = 75, 100
#: Equal minima, of BANDS * ROWS, below which a pair in a tile is not compared in full.
LEAST_EQUAL = 72
#: Members that one side of a tile of signatures holds on average; members and distinct shingles of one of sets.
SIGNATURE_ROWS, TILE_ROWS, TILE_SHINGLES = 4096, 512, 500_000
#: Documents whose ids are broadcast to pick their texts; with more, that join is shuffled.
BROADCAST_IDS = 1_000_000

_A, _B = tb.seeded(21, BANDS * ROWS) | tb.U64(1), tb.seeded(22, BANDS * ROWS)
_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def _minima(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x (BANDS * ROWS) minima, as 32-bit numbers; rows without values hold the largest number."""
    out = np.full((len(at) - 1, len(_A)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    step = 1 << 15
    with np.errstate(over="ignore"):
        if len(values) <= step:
            for k in range(len(_A)):
                out[full, k] = np.minimum.reduceat(values * _A[k] + _B[k], at[full]) >> tb.U64(32)
            return out
        first = 0
        while first < len(full):  # blocks that stay in the processor's cache
            last = max(first + 1, int(np.searchsorted(at[full], at[full[first]] + step)) - 1)
            rows = full[first:last]
            block = values[at[rows[0]] : at[rows[-1] + 1]]
            for k in range(len(_A)):
                out[rows, k] = np.minimum.reduceat(block * _A[k] + _B[k], at[rows] - at[rows[0]]) >> tb.U64(32)
            first = last
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * tb.U64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
        for r in range(ROWS):
            key = tb.mix(key ^ s[:, :, r]) * tb.U64(0xD1342543DE82EF95)
    return key.view(np.int64)


def _features(batches):
    enter("minhash")
    for batch in batches:
        ids = batch.column(0)
        for first, last, words, borders in tb.word_hashes(batch.column(1)):
            values, at = tb.distinct_per_row(*tb.shingles(words, borders, WIDTH))
            signature = _minima(values, at)
            n = np.diff(at)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[tb.U64(0)], np.cumsum(tb.mix(values ^ salt), dtype=np.uint64)]) for salt in (tb.U64(1), tb.U64(2))]
                keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(_band_keys(signature).ravel()))
            raw = pa.py_buffer(np.ascontiguousarray(signature))
            size = 4 * BANDS * ROWS
            signatures = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * size), raw])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first).cast(pa.int64()), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), signatures, bands],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
            )


def _sets(batches):
    """(doc_id, text) to (doc_id, its distinct shingles as sorted little-endian 64-bit numbers)."""
    enter("minhash")
    for batch in batches:
        for first, last, words, borders in tb.word_hashes(batch.column(1)):
            values, at = tb.distinct_per_row(*tb.shingles(words, borders, WIDTH))
            rows = [values[at[k] : at[k + 1]].tobytes() for k in range(last - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "shingles"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or OF * len(small) < SIMILAR * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return OF * same >= SIMILAR * (len(a) + len(b) - same)


def _confirm(batches):
    for batch in batches:
        a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
        hit = [k for k in range(len(a)) if _linked(np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64))]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in hit], pa.int64()), pa.array([b[k] for k in hit], pa.int64())], names=["a", "b"])


def _sides(table: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, components, sizes, signatures, and the rows of the left and the right side of a tile."""
    ids, group, sizes, side = (np.asarray(table.column(c)) for c in ("rep", "component", "n_shingles", "side"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
    diagonal = bool(table.column("diagonal")[0].as_py())
    return ids, group, sizes, signature, np.flatnonzero(side == 0), np.flatnonzero(side == (0 if diagonal else 1))


def _partners(table: pa.Table, sides: tuple[np.ndarray, ...]):
    """(left row, right rows) of a tile that are in different groups and alike by size and signature, in their first band."""
    ids, group, sizes, signature, left, right = sides
    band, diagonal = int(table.column("band")[0].as_py()), bool(table.column("diagonal")[0].as_py())
    for i in left:
        js = right[(ids[right] > ids[i]) if diagonal else np.ones(len(right), bool)]
        js = js[(group[js] != group[i]) & (OF * np.minimum(sizes[js], sizes[i]) >= SIMILAR * np.maximum(sizes[js], sizes[i]))]
        if not len(js):
            continue
        equal = signature[js] == signature[i]
        enough = equal.sum(1) >= LEAST_EQUAL
        js, equal = js[enough], equal[enough]
        if len(js):
            js = js[equal.reshape(len(js), BANDS, ROWS).all(2).argmax(1) == band]
            if len(js):
                yield i, js


def _surviving(table: pa.Table) -> pa.Table:
    """Members of a tile of signatures with a partner in it."""
    sides = _sides(table)
    seen = np.zeros(table.num_rows, bool)
    for i, js in _partners(table, sides):
        seen[i] = True
        seen[js] = True
    ids = np.unique(sides[0][seen])
    return pa.table({"bucket": pa.array(np.full(len(ids), table.column("bucket")[0].as_py()), pa.int64()), "rep": pa.array(ids, pa.int64())})


def _tile(table: pa.Table) -> pa.Table:
    """Links between the two sides of a tile with full sets."""
    sides = _sides(table)
    ids, group = sides[:2]
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    merged = {g: g for g in np.unique(group).tolist()}

    def root(g: int) -> int:
        while merged[g] != g:
            merged[g] = g = merged[merged[g]]
        return g

    out: list[tuple[int, int]] = []
    for i, js in _partners(table, sides):
        for j in js:
            if (p := root(int(group[i]))) != (q := root(int(group[j]))) and _linked(sets[i], sets[j]):
                merged[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _tiled(open_: DataFrame, rows: int, shingles: int | None, *payload: DataFrame):
    """open_(bucket, band, rep, component, n_shingles) with payload(rep, ...), grouped by pairs of tiles of each bucket."""
    # The largest group of a bucket needs no comparing inside itself: its members meet the others only.
    counted = open_.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    largest = counted.groupBy("bucket").agg(F.max_by(F.struct("component", "m", "s"), F.struct("m", "component")).alias("g"), F.sum("m").alias("n"), F.sum("s").alias("weight"))
    tiles = lambda n, weight: F.greatest(F.ceil(n / rows), F.ceil(weight / shingles) if shingles else F.lit(1), F.lit(1)).cast("int")
    largest = largest.select("bucket", F.col("g.component").alias("most"), tiles(F.col("g.m"), F.col("g.s")).alias("inner"), tiles(F.col("n") - F.col("g.m"), F.col("weight") - F.col("g.s")).alias("outer"))
    largest = stage(largest, "largest")
    dealt = open_.select("bucket", "band", "rep", "component", "n_shingles").join(largest, "bucket")
    for more in payload:
        dealt = dealt.join(more, "rep")
    carries = [c for more in payload for c in more.columns if c != "rep"]
    dealt = dealt.withColumn("among", F.col("component") == F.col("most"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("among"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # Tiles 0.. are the others', and -1, -2, .. the largest group's; a pair of tiles is (i, j) with i >= 0.
    met = F.when(F.col("among"), F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda t: F.struct(t.alias("i"), (-1 - F.col("tile")).alias("j"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"), F.when(t >= F.col("tile"), 0).otherwise(1).alias("side"))),
            F.transform(F.sequence(F.lit(1), F.col("inner")), lambda t: F.struct(F.col("tile").alias("i"), (-t).alias("j"), F.lit(0).alias("side"))),
        )
    )
    carried = dealt.select("bucket", "band", "rep", "component", "n_shingles", *carries, F.inline(met)).withColumn("diagonal", F.col("i") == F.col("j"))
    return carried.groupBy("bucket", "i", "j"), largest


def _bounded(ids: DataFrame) -> DataFrame:
    """A staged table of ids, broadcast where they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _named_once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with one row, that of its least text, for each doc_id that repeats; and those ids with their numbers of rows."""
    repeats = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    if repeats.isEmpty():
        release(repeats)
        return docs, None
    ids = _bounded(repeats.select("doc_id"))
    least = stage(docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "least")
    return docs.join(ids, "doc_id", "left_anti").select("doc_id", "text").unionByName(least), repeats


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents link when 100 * |A & B| >= 75 * |A | B| over their sets of five-word shingles; the set of a
    shorter text is its whole word sequence, that of an empty or null text is empty and links with nothing.
    component_id is the smallest doc_id reachable, kept marks it.  Other columns are not read.  A row whose
    doc_id is null cannot be named: it stays by itself, component_id null and kept true.  Rows that repeat a
    doc_id are one document, whose text is the least of theirs by code point (a null text only where all are),
    and come back as often as they came.  Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, repeats = _named_once(docs)
    features = stage_mapped(docs.mapInArrow(_features, _FEATURES), "features")
    named = features.where("doc_id is not null and n_shingles > 0")
    copies = stage(
        named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last"), "copies"
    )
    lone = named.select("doc_id", "n_shingles", "set_a", "set_b", "signature", "bands").join(copies, ["set_a", "set_b"], "left").where("rep is null or rep = doc_id")
    classes = lone.select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    members = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket")).select("bucket", "band", "rep", "n_shingles")
    order = F.struct(F.xxhash64("rep"), F.col("rep"))
    buckets = stage(
        members.groupBy("bucket")
        .agg(F.min(order).alias("least"), F.max("rep").alias("last"), F.min("rep").alias("first"), F.count("*").alias("n"))
        .where("first <> last")
        .select("bucket", F.col("least.rep").alias("centre"), "n"),
        "buckets",
    )
    shared = stage(members.join(buckets, "bucket"), "shared")
    reps = stage(shared.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    sets = stage_mapped(docs.join(_bounded(reps), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")
    pairs = stage(shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ab = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y")
    )
    stars = stage_mapped(ab.mapInArrow(_confirm, "a long, b long"), "stars")
    so_far = connected_components(stars)

    # Buckets of three or more classes whose members are still in several groups.
    grouped = shared.where("n > 2").join(so_far.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = stage(grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"), "apart")
    open_ = stage(grouped.join(apart, "bucket", "left_semi"), "open")
    done, links = [copies, buckets, shared, reps, sets, pairs, so_far, apart, open_], stars
    signatures = stage(features.select(F.col("doc_id").alias("rep"), "signature").join(open_.select("rep").distinct(), "rep", "left_semi"), "signatures")
    alike, largest = _tiled(open_, SIGNATURE_ROWS, None, signatures)
    surviving = stage(alike.applyInArrow(lambda t: _surviving(t), "bucket long, rep long").distinct(), "surviving")
    done += [signatures, largest, surviving]
    if not surviving.isEmpty():
        open_ = stage(open_.join(surviving, ["bucket", "rep"], "left_semi"), "open")
        tiles, largest = _tiled(open_, TILE_ROWS, TILE_SHINGLES, signatures, sets.withColumnRenamed("doc_id", "rep"))
        tiled = stage(tiles.applyInArrow(lambda t: _tile(t), "a long, b long"), "tiled")
        links = stars.unionByName(tiled)
        done += [open_, largest, tiled]
    groups = connected_components(links)
    out = (
        features.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(copies, ["set_a", "set_b"], "left")
        .withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.coalesce("component", "rep"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
    if repeats is not None:
        often = F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))
        out = out.join(repeats, "doc_id", "left").select(*out.columns, often).select(*out.columns)
    # One narrow row a document: written here, so that all that is larger can go.
    out = stage(out, "near")
    release(features, stars, groups, *done)
    return out
