"""Language-model scores: cross-entropy difference between a target and a background model.

Two interpolated bigram models count real words and pairs of words, each known by a 64-bit hash.  The
background model counts every document, the target model those of the target; background counts are scaled
to the target's size, so both models are smoothed alike.  A document's score is its mean loss a word under
the target model less that under the background model (Moore and Lewis, 2010): lower is more like the target.

The tables of counts grow with the corpus and are never in one place.  Documents are encoded once into
groups of about GROUP words; each group sends its distinct words and pairs, with its own counts, to buckets
of hashes; a bucket adds them up and answers every group for what it asked; each group is scored from its
answers.  A frequent word or pair is one entry a group, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .staging import release, stage, stage_mapped

#: Words the uniform model spreads over, at the least; with more distinct words in the corpus, their number.
VOCABULARY = 1 << 16
#: Weights of the pair model, the word model and the uniform one.
SHARES = (0.6, 0.35, 0.05)
#: Target ids that are broadcast; with more, documents are joined to them by a shuffle.
BROADCAST_IDS = 500_000
#: Words and rows of a group at most (a longer text stands alone), words of the corpus a bucket, and least buckets.
GROUP, GROUP_ROWS, BUCKET, BUCKETS = 1 << 20, 1 << 16, 1 << 21, 512
#: What stands before a text's first word.
_START = tb.seeded(13, 1)

_GROUP = "grp long, n_words long, n_wanted long, doc_ids array<long>, lengths binary, wanted binary, words binary, places binary"
_ASKED = "bucket int, grp long, ends binary, ends_n binary, keys binary, keys_n binary"
_ANSWER = "bucket int, grp long, ends_n binary, keys_n binary"


def _pack(x: np.ndarray) -> bytes:
    """An array of whole numbers from 0, as narrow as it may be, byte by byte of all of them, compressed."""
    narrow = x.astype(np.uint32 if not x.size or x.max() < 1 << 32 else np.uint64)
    raw = bytes([narrow.itemsize]) + narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(np.uint32 if raw[0] == 4 else np.uint64).ravel().astype(kind)


def encode(docs: DataFrame) -> DataFrame:
    """Staged groups of docs(doc_id, text, wanted): the distinct words, and their numbers place by place."""

    def group(number: int, ids: list, hashes: list, lengths: list, wanted: list) -> pa.RecordBatch:
        w, n, wanted = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(wanted)
        words, at = np.unique(w, return_inverse=True)
        often = np.argsort(-np.bincount(at), kind="stable")  # frequent words get the small numbers, which pack best
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        row = [number, len(w), int(n[wanted].sum()), ids, _pack(n), _pack(wanted), words[often].tobytes(), _pack(rank[at])]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in _GROUP.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list, list] = ([], [], [], [])
        words = 0
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), np.asarray(batch.column(2).cast(pa.int8())) == 1
            for first, last, hashes, borders in tb.word_hashes(batch.column(1)):
                if held[0] and (words + len(hashes) > GROUP or len(held[0]) + last - first > GROUP_ROWS):
                    yield group(number, *held)
                    number, held, words = number + 1, ([], [], [], []), 0
                for x, more in zip(held, (ids[first:last], [hashes], [np.diff(borders)], [wanted[first:last]])):
                    x.extend(more)
                words += len(hashes)
        if held[0]:
            yield group(number, *held)

    return stage_mapped(docs.select("doc_id", "text", "wanted").mapInArrow(run, _GROUP), "groups")


def _known(row: dict) -> tuple[np.ndarray, ...]:
    """Of a group: hashes of the start and all words, distinct pairs' first and second ones, their hashes, the pair at each place."""
    ends, at, n = np.concatenate([_START, np.frombuffer(row["words"], np.uint64)]), _unpack(row["places"]), _unpack(row["lengths"])
    code = np.empty(len(at), np.int64)
    code[1:] = at[:-1] + 1
    code[(np.cumsum(n) - n)[n > 0]] = 0  # the start of a text
    code *= len(ends)
    code += at + 1
    pairs, occurs = np.unique(code, return_inverse=True)
    first, second = np.divmod(pairs, len(ends))
    with np.errstate(over="ignore"):
        return ends, first, second, tb.mix(ends[first] * tb.U64(0x9E3779B97F4A7C15) + ends[second]), occurs


def ask(groups: DataFrame, bits: int) -> DataFrame:
    """What each group asks each bucket: its words and pairs there and their counts, (all, wanted) of words, contexts and pairs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends, first, second, keys, occurs = _known(row)
                inside = np.repeat(_unpack(row["wanted"]) == 1, _unpack(row["lengths"]))
                of_pairs = [np.bincount(x, minlength=len(keys)) for x in (occurs, occurs[inside])]
                of_ends = [np.bincount(place, weights=n, minlength=len(ends)) for place in (second, first) for n in of_pairs]
                out = []
                for hashes, counts in ((ends, of_ends), (keys, of_pairs)):
                    order = np.argsort(hashes)
                    cuts = np.searchsorted(hashes[order] >> tb.U64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    out.append((hashes[order], np.stack(counts, 1).astype(np.uint32)[order], cuts))
                buckets = np.flatnonzero((np.diff(out[0][2]) > 0) | (np.diff(out[1][2]) > 0))
                columns = [[_pack(x[c[b] : c[b + 1]].T.ravel() if x.ndim > 1 else np.diff(x[c[b] : c[b + 1]], prepend=tb.U64(0))) for b in buckets] for h, n, c in out for x in (h, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), row["grp"]), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]],
                    names=["bucket", "grp", "ends", "ends_n", "keys", "keys_n"],
                )

    return groups.select("grp", "lengths", "wanted", "words", "places").mapInArrow(run, _ASKED)


def _answer(asked: pa.Table) -> pa.Table:
    """The sums over all groups of one bucket, for each group in the order it asked."""
    out = []
    for name, width in (("ends", 4), ("keys", 2)):
        parts = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in asked.column(name).to_pylist()]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([_unpack(x).reshape(width, -1) for x in asked.column(f"{name}_n").to_pylist()], 1)
        sums = np.stack([np.bincount(at, weights=n)[at] if len(at) else np.zeros(0) for n in counts]).astype(np.int64)
        cuts = np.cumsum([0, *map(len, parts)])
        out.append(pa.array([_pack(sums[:, a:b].ravel()) for a, b in zip(cuts, cuts[1:])], pa.binary()))
    return pa.table([asked.column("bucket"), asked.column("grp"), *out], names=["bucket", "grp", "ends_n", "keys_n"])


def _words(groups: DataFrame) -> int:
    """Distinct words of all groups."""

    def run(batches):
        for batch in batches:
            for words in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64))], names=["word"])

    return groups.select("words").mapInArrow(run, "word long").distinct().count()


def _scorer(totals: tuple[int, int], vocabulary: int):
    """Scores one group from its answers; totals are the words of all documents and of the target's."""
    scales = (totals[1] / totals[0] if all(totals) else 1.0, 1.0)

    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        row = groups.to_pylist()[0]
        ends, first, second, keys, occurs = _known(row)
        n = _unpack(row["lengths"])
        answers = answers.sort_by("bucket")
        counts = []
        for name, width, hashes in (("ends_n", 4, ends), ("keys_n", 2, keys)):
            got = np.empty((width, len(hashes)))
            got[:, np.argsort(hashes)] = np.concatenate([_unpack(x).reshape(width, -1) for x in answers.column(name).to_pylist()], 1)
            counts.append(got)
        out = []
        for k in (1, 0):  # the target's model, then the background's
            word = (counts[0][k] * scales[k] + 0.1) / (totals[k] * scales[k] + 0.1 * vocabulary)
            # Every context of the corpus is in the background; in the target one may be missing.
            seen = counts[0][2 + k][first]
            given = np.where(seen > 0, counts[1][k] / np.maximum(seen, 1), word[second])
            loss = -np.log(SHARES[0] * given + SHARES[1] * word[second] + SHARES[2] / vocabulary)
            mean = np.zeros(len(n))
            if len(occurs):
                mean[n > 0] = np.add.reduceat(loss[occurs], (np.cumsum(n) - n)[n > 0]) / n[n > 0]
            out.append(mean)
        values = [pa.array(x, pa.float64(), mask=n == 0) for x in (*out, out[0] - out[1])]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(n, pa.int64()), *values], names=["doc_id", "n_words", "target_loss", "background_loss", "difference"])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference) for every row of docs(doc_id, text, ...).

    target_ids(doc_id) names the documents of the target model; nulls in it and repeats do not matter, and
    without any of them the target model is uniform.  Losses are natural logarithms a word over the whole
    text.  Null and empty texts have no words, null losses and a null difference.  A null doc_id is carried
    along and never in the target.  Other columns are not read.  Empty table: no rows.
    """
    ids = stage(target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("wanted", F.lit(True)), "target")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left")
    groups = encode(marked.withColumn("wanted", F.coalesce("wanted", F.lit(False))))
    release(ids)
    totals = groups.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_wanted"), F.lit(0))).first()
    bits = (max(BUCKETS, -(-totals[0] // BUCKET)) - 1).bit_length()
    answers = ask(groups, bits).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    score = _scorer(tuple(totals), max(VOCABULARY, _words(groups)))
    held = groups.select("grp", "doc_ids", "lengths", "words", "places")
    return held.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, difference double")
