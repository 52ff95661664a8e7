"""Packing documents into fixed windows of tokens: concatenate and cut.

Pass 1 tokenises every document once and notes, inside each partition, how many tokens come before it.
Prefix sums over the partitions' totals (one number a partition) then place every partition in one global
stream, so pass 2 cuts each document at multiples of the window by itself: no sort, no shuffle of tokens.
Boundary records say where a document runs on over the edge of a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage_mapped
from .tokens import default_tokenizer, encoder
from .worker import enter

WINDOW = 2048
END_ID = 1
_TOKENS = "part long, before long, doc_id long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean, sequence_tokens long, padded_to long, ids binary, slot long"
#: Rows tokenised together.
_ROWS = 256


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids): `before` counts the part's tokens ahead of the row.

    The order is that of the scan's partitions: it has to be written before anything reads it twice.
    """

    def run(batches):
        enter("tokens")
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(k, _ROWS)
                ids = [x + end for x in enc.encoded(rows.column(1).to_pylist())]
                n = np.array([len(x) // width for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n), rows.column(0).cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "before", "doc_id", "n_tokens", "ids"],
                )
                before += int(n.sum())

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, _TOKENS)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """tokenised, staged."""
    return stage_mapped(tokenised(docs, tokenizer, end_id), "tokens", "zstd")


def placed(tokens: DataFrame) -> tuple[DataFrame, int]:
    """tokens with `at`, the row's place in the one stream of all tokens, and the length of that stream."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    # One row for each partition of the input: bounded by the scan's splits, not by its rows.
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("before")), total


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document of docs(doc_id, text, ...).

    A document is the ids of its whole text followed by end_id; a null or empty text is end_id alone.
    Pieces: doc_id, start (the document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset in that sequence; boundary record: opens and closes
    (whether the document begins, ends in this piece), sequence_tokens, and padded_to: the window, or the
    sequence's own length where that is a power of two.  Only the last sequence can be short.  Repeated
    rows are packed as often as they come, a null doc_id is carried along, other columns are not read, an
    empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    return pieces(*placed(tokenise(docs, path, end_id)), path, window).drop("ids", "slot")


def packed(raw: bytes, width: int) -> bytes:
    """Ids for the way: byte by byte of all of them, compressed; half of what the ids take."""
    planes = np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(4, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    planes = pa.decompress(data[5:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(data[4], -1).T.tobytes()


def pieces(stream: DataFrame, total: int, path: str, window: int, slots: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The pieces of a placed stream; slots adds to each its sequence's slot and its ids, packed."""
    wide = encoder(path).dtype

    def cut(batches):
        for batch in batches:
            at, doc, ids = (batch.column(k) for k in range(3))
            rows = []
            for a, d, raw in zip(at.to_pylist(), doc.to_pylist(), ids.to_pylist()):
                x = np.frombuffer(raw, wide).astype("<u4")
                edges = [0, *range(window - a % window, len(x), window), len(x)] if len(x) > window - a % window else [0, len(x)]
                for s, e in zip(edges, edges[1:]):
                    seq = (a + s) // window
                    held = min(window, total - seq * window)
                    rows.append((d, s, e - s, zlib.crc32(x[s:e].tobytes()), len(x), seq, (a + s) % window, s == 0, e == len(x), held, held if held & (held - 1) == 0 else window, packed(raw[s * wide.itemsize : e * wide.itemsize], wide.itemsize) if slots else None))
            types = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.binary()]
            columns = list(zip(*rows)) or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays.append(pa.array(slots(np.array(columns[5], dtype=np.int64)) if slots and rows else np.zeros(len(rows), np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PIECES.split(", ")])

    return stream.select("at", "doc_id", "ids").mapInArrow(cut, _PIECES)
