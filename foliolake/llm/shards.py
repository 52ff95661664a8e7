"""Training-order materialisation: every packed sequence gets a global slot by a keyed permutation.

The slot of a sequence is a Feistel network over its number, walked in cycles until it falls below the number
of sequences: a bijection that needs no sort and no table, and that the inverse undoes.  Slots are dealt by
range to binary files of fixed stride: slot s is record s mod per_shard of shard s div per_shard, so a reader
finds any slot by arithmetic, seeks there, and resumes anywhere.

A shard is one file, `part-<shard>-...`, of records that are all `record` bytes long: the slot (unsigned 64
bits), the number of ids (unsigned 32 bits), `window` ids (unsigned, 16 bits where the vocabulary allows, else
32) filled up with pad_id, and a line feed; all numbers little-endian.  Beside the shards lie `_layout.json`
(sequences, tokens, window, width, per_shard, key, record), `_documents`, a Parquet table of the documents of each
sequence, and `_tokens`, the one stream of all tokens in the order in which it was first made.  Spark's writer
gives a shard its name only when it is whole; a run that was cut off is continued by running it again, which
writes the missing shards only, from `_tokens`: what the input's splits are by then does not matter.
`_stream.json` says of which rows and tokenizer that stream is; other rows raise.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from .staging import BYTES, ROWS, arrow_batches, file_system, read_text, write_text
from .textbytes import U64, mix, seeded
from .tokens import encoder

ROUNDS = 6
#: Records of a shard: some 17 MB at 2048 ids of 16 bits.
PER_SHARD = 4096
#: Records handed on together.
_TOGETHER = 256


class Feistel:
    """A keyed permutation of range(n) on numpy arrays: slot(x), and its inverse number(slot)."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = seeded(key, ROUNDS)
        self.mask = U64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (mix(right + k) & self.mask)
        return right << U64(self.half) | left  # halves exchanged: the same network with its keys reversed is the inverse

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._once(np.asarray(x).astype(U64), keys)
        while (far := out >= U64(self.n)).any():
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def _record(window: int, wide: np.dtype) -> np.dtype:
    return np.dtype([("slot", "<u8"), ("n", "<u4"), ("ids", wide, (window,)), ("end", "u1")])


def _strings(records: np.ndarray) -> pa.Array:
    """Records as an Arrow column of strings: their bytes as they are, for the line writer."""
    size = records.dtype.itemsize
    return pa.Array.from_buffers(pa.string(), len(records), [None, pa.py_buffer(np.arange(len(records) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(records).tobytes())])


def _files(spark: SparkSession, path: str) -> dict[int, str]:
    """Whole shards by number."""
    fs, folder = file_system(spark, path)
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen() > 0:
            found[int(name.split("-")[1])] = status.getPath().toString()
    return found


def layout(spark: SparkSession, path: str) -> dict[str, int]:
    return json.loads(read_text(spark, f"{path}/_layout.json"))


def _sum(df: DataFrame, *columns: str) -> str:
    """Rows, and the sum of their hashes: the same for the same rows in any order."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def _stream(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """The stream of all tokens kept at path, made if it is not there; raises if it is of other rows or another order.

    Without `_tokens` (it was dropped) the stream is made again, and has to come out in the order that was noted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of = {"rows": _sum(rows, "doc_id", "text"), "tokenizer": sha256_of(tokenizer), "end_id": end_id}
    noted = json.loads(read_text(spark, f"{path}/_stream.json") or "{}")
    if noted and {k: noted[k] for k in of} != of:
        raise ValueError(f"{path} holds shards of other rows or another tokenizer: {noted}, now {of}")
    folder = f"{path}/_tokens"
    if not noted or read_text(spark, f"{folder}/_SUCCESS") is None:
        with arrow_batches(spark, ROWS, BYTES):
            packing.tokenised(docs, tokenizer, end_id).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    tokens = spark.read.schema(packing._TOKENS).parquet(folder)
    order = _sum(tokens, "part", "before", "doc_id", "n_tokens")
    if noted and noted["order"] != order:
        drop_tokens(spark, path)
        raise ValueError(f"{path} holds shards of another order of the same rows; keep_tokens=True keeps it, here it was dropped")
    if not noted:
        write_text(spark, f"{path}/_stream.json", json.dumps(of | {"order": order}))
    return tokens


def sha256_of(file: str) -> str:
    with open(file, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def drop_tokens(spark: SparkSession, path: str) -> None:
    """Deletes the stream that a resumed run would go on from; the shards stay whole without it."""
    fs, folder = file_system(spark, f"{path}/_tokens")
    fs.delete(folder, True)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, window: int = packing.WINDOW, end_id: int = packing.END_ID, key: int = 2024, per_shard: int = PER_SHARD, pad_id: int = 0, keep_tokens: bool = True) -> dict[str, int]:
    """Packs docs and writes the shards to `path`; returns the layout.

    Shards that are there already stay; a path with another layout, or with shards of other rows, raises.  With
    keep_tokens the stream stays beside the shards, so that lost ones can be written again in the same order under
    any splits of the input; without it that takes the same splits, and others raise.  Null texts are empty documents, null
    doc_ids are left out of `_documents`, repeated rows are packed as often as they come, other columns are not
    read; an empty table writes no shard.
    """
    spark, file = docs.sparkSession, tokenizer or packing.default_tokenizer()
    tokens = _stream(docs, path, file, end_id)
    stream, total = packing.placed(tokens)
    n, wide = -(-total // window), encoder(file).dtype
    kind = _record(window, wide)
    lines = np.dtype(kind.descr[:-1])  # the line writer adds the line feed
    plan = {"sequences": n, "tokens": total, "window": window, "width": wide.itemsize, "per_shard": per_shard, "key": key, "record": kind.itemsize}
    if (before := read_text(spark, f"{path}/_layout.json")) is None:
        write_text(spark, f"{path}/_layout.json", json.dumps(plan))
    elif json.loads(before) != plan:
        raise ValueError(f"{path} holds shards of another layout: {before}")

    if read_text(spark, f"{path}/_documents/_SUCCESS") is None:
        ends = F.floor((F.col("at") + F.col("n_tokens") - 1) / window)
        inside = stream.where("doc_id is not null").select("at", "doc_id", F.explode(F.sequence(F.floor(F.col("at") / window), ends)).alias("sequence_id"))
        # A sequence holds `window` documents at most: each has a token.
        held = inside.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id"))).alias("d"))
        held.select("sequence_id", F.col("d.doc_id").alias("doc_ids")).write.mode("overwrite").parquet(f"{path}/_documents")

    def assemble(batches):
        records, at, slot = np.zeros(_TOGETHER, lines), -1, None
        for batch in batches:
            for s, off, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != slot:
                    if at == _TOGETHER - 1:
                        yield pa.RecordBatch.from_arrays([_strings(records)], names=["record"])
                        at = -1
                    slot, at = s, at + 1
                    records[at] = (s, 0, pad_id)
                ids = np.frombuffer(packing.unpacked(packed), wide)
                records[at]["ids"][off : off + len(ids)] = ids
                records[at]["n"] += len(ids)
        if at >= 0:
            yield pa.RecordBatch.from_arrays([_strings(records[: at + 1])], names=["record"])

    shards, done = -(-n // per_shard), _files(spark, path)
    if len(done) < shards:
        pieces = packing.pieces(stream, total, file, window, slots=Feistel(n, key).slot)
        dealt = pieces.select(F.floor(F.col("slot") / per_shard).cast("int").alias("shard"), "slot", "offset", "ids")
        if done:
            missing = spark.createDataFrame([(k,) for k in range(shards) if k not in done], "shard int")
            dealt = dealt.join(F.broadcast(missing), "shard", "left_semi")
        # Slots are even over their range: a task writes one shard, and its number is the shard's.
        whole = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "offset").select("slot", "offset", "ids")
        with arrow_batches(spark, 512):
            # Each task's file is moved to its place when it is whole, not all at the end of the job.
            whole.mapInArrow(assemble, "record string").write.mode("append").option("lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    if not keep_tokens:
        drop_tokens(spark, path)
    return plan


def _read(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each slot, read back from the shards: slot, shard, byte_offset, sequence_id, n_tokens, ids_crc32, doc_ids."""
    plan, files = layout(spark, path), _files(spark, path)
    out = "slot long, shard long, byte_offset long, sequence_id long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], out + ", doc_ids array<long>")
    kind, order = _record(plan["window"], np.dtype(f"<u{plan['width']}")), Feistel(plan["sequences"], plan["key"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                records = np.frombuffer(raw, kind)
                slot, n = records["slot"].astype(np.int64), records["n"].astype(np.int64)
                if (slot != shard * plan["per_shard"] + np.arange(len(slot))).any():
                    raise ValueError(f"shard {shard} is not in order")
                crc = [zlib.crc32(r["ids"][: r["n"]].astype("<u4").tobytes()) for r in records]
                columns = [slot, np.full(len(slot), shard), np.arange(len(slot)) * kind.itemsize, order.number(slot), n, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in out.split(", ")])

    held = spark.read.schema("sequence_id long, doc_ids array<long>").parquet(f"{path}/_documents")
    return _read(spark, list(files.values())).mapInArrow(run, out).join(held, "sequence_id", "left").select(*[c.split()[0] for c in out.split(", ")], F.coalesce("doc_ids", F.array().cast("array<long>")).alias("doc_ids"))


def read_slots(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(slot, ids binary) of a run of slots in order: only the shards that hold them are read."""
    plan, files = layout(spark, path), _files(spark, path)
    kind, per = _record(plan["window"], np.dtype(f"<u{plan['width']}")), plan["per_shard"]
    wanted = [files[k] for k in range(first // per, (min(first + count, plan["sequences"]) - 1) // per + 1) if k in files]
    if count <= 0 or not wanted:
        return spark.createDataFrame([], "slot long, ids binary")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column(0)[k].as_py() * per
                records = np.frombuffer(batch.column(1)[k].as_buffer(), kind)[max(0, first - start) : max(0, first + count - start)]
                yield pa.RecordBatch.from_arrays([pa.array(records["slot"].astype(np.int64)), pa.array([r["ids"][: r["n"]].tobytes() for r in records], pa.binary())], names=["slot", "ids"])

    return _read(spark, wanted).mapInArrow(run, "slot long, ids binary").orderBy("slot")


def seek(spark: SparkSession, path: str, slot: int, count: int = 1) -> list[np.ndarray]:
    """The ids of `count` slots from `slot` on, by seeking in the files; what lies before is not read."""
    plan, files = layout(spark, path), _files(spark, path)
    kind, per, out = _record(plan["window"], np.dtype(f"<u{plan['width']}")), plan["per_shard"], []
    while count > 0 and slot < plan["sequences"]:
        take = min(count, per - slot % per, plan["sequences"] - slot)
        fs, file = file_system(spark, files[slot // per])
        stream = fs.open(file)
        try:
            stream.seek(slot % per * kind.itemsize)
            raw = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, take * kind.itemsize)
        finally:
            stream.close()
        out += [r["ids"][: r["n"]].copy() for r in np.frombuffer(bytes(raw), kind)]
        slot, count = slot + take, count - take
    return out
