"""Two tokenizers laid side by side: which tokens of one stand for which of the other, and how often in the corpus.

Byte offsets where tokens of both end cut a text into groups; tokens whose bytes overlap are linked.  A pair of ids is
one packed 64-bit key, a * 2**32 + b.  Texts are tokenised once and their distinct keys staged.  Each partition counts
the documents that hold a pair by np.unique over those; partial counts are dealt by ranges of keys, sorted and summed over runs of equal keys; each
range is one shard file of sorted keys and their counts.  Lookups map the shards into memory and use searchsorted.

Neither tokenizer joins a character that is no space with a space after it, so a text falls into units, each with the
spaces before it, whose tokens, groups and links do not depend on what stands around them.  Units recur; what is known
of them is kept in a bounded table.  Tokenizers for which that does not hold see every text as one unit.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import file_system, parts_of, release, shared_dir, stage, stage_mapped
from .worker import enter

#: Units that one worker keeps, the longest of them in characters, and units looked at together.
KEPT, KEPT_CHARS, TOGETHER = 200_000, 64, 50_000
#: Distinct keys a partition gathers before it hands on its counts.
PARTIAL = 1 << 21
#: Counted pairs to a shard.
SHARD = 1 << 22
_ROWS = 256
_SPACED = re.compile(r"\s ")
#: How the byte-level tokenizer cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of units: (valid, n_a, n_b, n_groups, keys of links, groups as text)."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = _byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._one = self._fast(byte_path)
        probe = "A  bc, it's 9 x--y \n\n z\t ÉÜ.  'd "
        self.by_unit = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.encode(probe) == [i for u in self._cut(probe) for i in self.b.encode(u[1:])]
        self.by_unit = self.by_unit and self._one(" " + probe) == [i for u in self._cut(probe) for i in self._one(u)]
        # Ids as text with what follows them: a comma, or at the end of a group's side a bar (first) or semicolon (second).
        most = max(self.a_bytes) + 1
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in ([self.a_bytes.get(i, b"") for i in range(most)], self.b_bytes))
        self.spelt = [b"%d%s" % (i, c) for n, ends in ((most, b",|"), (len(pieces), b",;")) for c in (ends[:1], ends[1:]) for i in range(n)]
        self.spelt_size = np.array([len(x) for x in self.spelt], np.int64)
        self.known: dict[str, tuple] = {}

    def _whole(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def _fast(self, path: str) -> Callable[[str], list[int]]:
        """The byte-level tokenizer by tiktoken, if its merges are in the order of their ids, else by itself."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", ())]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        if ids == sorted(ids) and not model.get("ignore_merges") and len(ranks) >= 256:
            import tiktoken

            fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            probes = ["", " it's  a 12 b--c \n\n d\t É日本'll", " <|endoftext|> x\u00a0 y'S 'd", " " * 9 + "ab"]
            if all(fast(t) == self._whole(t) for t in probes):
                return fast
        return self._whole

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Units of a space and text: cut before a space that no white space stands before."""
        parts = text.split(" ")
        if text[0] != " " and text[-1] != " " and not _SPACED.search(text):
            return [" " + p for p in parts]
        out, now = [], ""
        for p in parts:
            now += " " + p
            if p and not p[-1].isspace():
                out.append(now)
                now = ""
        if now and now.strip(" "):
            out.append(now)
        elif now:  # spaces at the end belong to the last unit
            out.append(out.pop() + now if out else now)
        return out

    def units(self, text: str) -> list[str]:
        return self._cut(text) if self.by_unit else [" " + text]

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self._one(u) for u in units], self.b.encode([u[1:] for u in units], num_threads=1)

    def fresh(self, units: list[str]) -> list[tuple]:
        """Records of units, tokenised and aligned together as if they were one text."""
        a, b = self.tokens(units)
        raw = [u.encode() for u in units]
        fits = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw)]
        good = [k for k, f in enumerate(fits) if f]
        n_a, n_b = (np.array([len(x[k]) for k in good], np.int64) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x[k] for k in good), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        cuts = np.union1d(ends_a, ends_b)  # a link ends at each of them
        if not len(cuts):
            return [(False, 0, 0, 0, b"", b"")] * len(units)
        of_a, of_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        keys = (ids_a[of_a] << 32 | ids_b[of_b]).tobytes()
        both = cuts[(ends_a[of_a] == cuts) & (ends_b[of_b] == cuts)]  # and a group at each of these
        ends = np.cumsum([len(raw[k]) for k in good])
        links, groups = (np.append(0, np.searchsorted(x, ends, "right")) for x in (cuts, both))
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = both[in_a] == ends_a, both[in_b] == ends_b
        half_a, half_b = len(self.a_size), len(self.b_size)
        spelt = np.concatenate([ids_a + half_a * last_a, 2 * half_a + ids_b + half_b * last_b])
        spelt = spelt[np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")]
        text = b"".join([self.spelt[i] for i in spelt.tolist()])
        at = np.append(0, np.cumsum(self.spelt_size[spelt]))[np.append(0, np.cumsum(n_a + n_b))]
        out: list[tuple] = [(False, 0, 0, 0, b"", b"")] * len(units)
        for k, x, y, g, l0, l1, s, e in zip(good, n_a.tolist(), n_b.tolist(), np.diff(groups).tolist(), links.tolist(), links[1:].tolist(), at.tolist(), at[1:].tolist()):
            out[k] = (True, x, y, g, keys[8 * l0 : 8 * l1], text[s : e - 1])
        return out

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], list[tuple]]]:
        """(row, units, records) of texts, about TOGETHER units looked up at a time; a long text comes in several."""
        held, n = [], 0
        for row, text in enumerate(texts):
            units = self.units(text) if text else []
            for k in range(0, len(units), TOGETHER):
                own = units[k : k + TOGETHER]
                if held and n + len(own) > TOGETHER:
                    yield from self._looked(held)
                    held, n = [], 0
                held.append((row, own))
                n += len(own)
        if held:
            yield from self._looked(held)

    def _looked(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[str], list[tuple]]]:
        known = self.known
        new = [u for u in dict.fromkeys(chain.from_iterable(own for _, own in held)) if u not in known]
        found = dict(zip(new, self.fresh(new))) if new else {}
        if (room := KEPT - len(known)) > 0:  # what is frequent comes early
            known.update(islice(((u, v) for u, v in found.items() if len(u) <= KEPT_CHARS), room))
        for row, own in held:
            yield row, own, [known[u] if u in known else found[u] for u in own]


def _texts(batches) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in parts_of(batches, _ROWS):
        yield batch.column(0), batch.column(1).to_pylist()


_SPELT = "doc_ids array<long>, digests array<string>, groups array<string>, sizes binary, keys binary, times binary"


def _zip(x: np.ndarray) -> bytes:
    """Numbers byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unzip(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def spell(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None, groups: bool = False) -> DataFrame:
    """Staged rows for some texts each: their ids and digests of groups, (n_a, n_b, n_groups, distinct keys), keys and how often."""
    defaults = (byte_tokenizer and piece_model) or default_tokenizers()
    paths = (byte_tokenizer or defaults[0], piece_model or defaults[1])

    def run(batches):
        enter("alignment")
        aligner = Aligner(*paths)
        for ids, texts in _texts(batches):
            sizes, digests, spelt = np.zeros((len(texts), 4), np.int64), [hashlib.sha256() for _ in texts], [[] for _ in texts]
            valid, begun = [bool(t) for t in texts], [False] * len(texts)
            own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
            for row, _, found in aligner.blocks(texts):
                ok, n_a, n_b, n_groups, keys, spellings = zip(*found)
                valid[row] = valid[row] and all(ok)
                sizes[row, :3] += (sum(n_a), sum(n_b), sum(n_groups))
                piece = (b";" if begun[row] else b"") + b";".join(spellings)
                begun[row] = True
                digests[row].update(piece)
                own[row].append(np.unique(np.frombuffer(b"".join(keys), np.int64), return_counts=True))
                if groups:
                    spelt[row].append(piece)
            keys, times = [], []
            for row, parts in enumerate(own):
                if not valid[row]:
                    sizes[row] = 0
                    continue
                k, n = parts[0] if len(parts) == 1 else _added(*(np.concatenate(x) for x in zip(*parts)))
                sizes[row, 3] = len(k)
                keys.append(k)
                times.append(n)
            every = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            row = [ids.cast(pa.int64()).to_pylist(), [d.hexdigest() if v else "" for d, v in zip(digests, valid)], [b"".join(x).decode() if v else "" for x, v in zip(spelt, valid)] if groups else None, _zip(sizes), _zip(every(keys)), _zip(every(times).astype("<u4"))]
            types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in _SPELT.split(", ")])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage_mapped(plain.mapInArrow(run, _SPELT), "spelt")


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _counted(batches):
    """What spell made to partial counts (key, n): of the partition's documents, n hold the pair."""
    enter("alignment")
    keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        more, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return _added(np.concatenate([keys, more]), np.concatenate([counts, n]))

    def handed_on():
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], names=["key", "n"])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            held.append(_unzip(data, "<i8"))
            size += len(held[-1])
            if size > PARTIAL:
                (keys, counts), held, size = merged(), [], 0
                if len(keys) > PARTIAL:
                    yield from handed_on()
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield from handed_on()


def _summed(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, n) rows to distinct keys and their sums, batch by batch; a run may go on in the next batch."""
    last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        k, n = (np.concatenate([x, np.asarray(batch.column(c))]) for c, x in enumerate(last))
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, n = k[at], np.add.reduceat(n, at)
        yield k[:-1], n[:-1]
        last = k[-1:], n[-1:]
    yield last


def _shards(folder: str):
    """A range of sorted partial counts to one shard file: its keys, then their counts; and its row of the manifest."""

    def run(batches):
        enter("alignment")
        parts = list(_summed(batches))
        k, n = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        if not len(k):
            return
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, draft = f"{base}/{TaskContext.get().partitionId():06d}", f"{base}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(k.tobytes())
            out.write(n.tobytes())
        system.move(draft, name)
        at = np.flatnonzero(np.concatenate([[True], (k >> 32)[1:] != (k >> 32)[:-1]]))
        best = np.stack([k[at] >> 32, np.maximum.reduceat(n, at)])
        row = [name.rpartition("/")[2], int(k[0]), int(k[-1]), len(k), best.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["name", "first", "last", "n", "best"])

    return run


class PairCounts:
    """Shards of sorted pair counts in a folder: one row a shard is here, the counts stay in the files."""

    def __init__(self, folder: str, rows: list):
        self.folder = folder
        self.rows = sorted((r["first"], r["last"], r["n"], r["name"]) for r in rows)
        #: Of each id of the first tokenizer the highest count: as many as its vocabulary has at most.
        self.best = np.zeros(1, np.int64)
        for r in rows:
            a, n = np.frombuffer(r["best"], np.int64).reshape(2, -1)
            if len(self.best) <= a[-1]:
                self.best = np.concatenate([self.best, np.zeros(int(a[-1]) + 1 - len(self.best), np.int64)])
            np.maximum.at(self.best, a, n)

    def _shard(self, name: str, n: int) -> np.ndarray:
        system, base = pafs.FileSystem.from_uri(self.folder)
        if isinstance(system, pafs.LocalFileSystem):
            return np.memmap(f"{base}/{name}", np.int64, mode="r", shape=(2, n))
        with system.open_input_file(f"{base}/{name}") as file:
            return np.frombuffer(file.read(), np.int64).reshape(2, n)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; 0 for a pair that no document holds."""
        out = np.zeros(len(keys), np.int64)
        for first, last, n, name in self.rows:  # one shard at a time, whatever their number
            a, b = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
            if a < b:
                shard = self._shard(name, n)
                at = np.minimum(np.searchsorted(shard[0], keys[a:b]), n - 1)
                out[a:b] = np.where(shard[0][at] == keys[a:b], shard[1][at], 0)
        return out


def pair_counts(spelt: DataFrame) -> PairCounts:
    """How many of the texts that spell saw hold each linked pair of ids; its shards stay until `drop`."""
    spark = spelt.sparkSession
    partial = stage_mapped(spelt.select("keys").mapInArrow(_counted, "key long, n long"), "pairs")
    folder = f"{shared_dir(spark)}/foliolake/pair-counts-{uuid.uuid4().hex}"
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partial.count() // SHARD)
    dealt = partial.repartitionByRange(wide, "key").sortWithinPartitions("key")
    manifest = stage(dealt.mapInArrow(_shards(folder), "name string, first long, last long, n long, best binary"), "pair_manifest")
    out = PairCounts(folder, manifest.collect())  # a row for each shard
    release(partial, manifest)
    return out


def drop(docs: DataFrame, counts: PairCounts) -> None:
    fs, folder = file_system(docs.sparkSession, counts.folder)
    fs.delete(folder, True)


def pairs(docs: DataFrame, counts: PairCounts) -> DataFrame:
    """(a_id, b_id, n_docs): the shards as a table."""

    def run(batches):
        for batch in batches:
            for first, last, n, name in zip(*(batch.column(c).to_pylist() for c in range(4))):
                shard = counts._shard(name, n)
                for k in range(0, n, 1 << 16):
                    key = np.array(shard[0, k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(np.array(shard[1, k : k + (1 << 16)]))], names=["a_id", "b_id", "n_docs"])

    return docs.sparkSession.createDataFrame(counts.rows, "first long, last long, n long, name string").mapInArrow(run, "a_id long, b_id long, n_docs long")


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None, groups: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): how its tokens by both tokenizers fit together.

    n_a, n_b: tokens of a space and the text; n_groups; n_links: pairs of tokens whose bytes overlap; count_sum: over
    links, how many documents of docs hold that pair of ids; n_best: links whose count is the highest of their first
    id; groups_sha256: digest of `a1,a2|b1;a3|b2,b3`, and with `groups` that text itself beside it.

    A null or empty text, and one that the tokenizers do not give back byte by byte, has no tokens: zeros and ''.
    Such a text holds no pair.  Repeated rows count as often as they come, null doc_ids are carried along, other columns
    are not read; an empty table gives no rows.
    """
    spelt = spell(docs, byte_tokenizer, piece_model, groups)
    counts = pair_counts(spelt)
    schema = _OUT + (", groups string" if groups else "")

    def run(batches):
        enter("alignment")
        best = np.append(counts.best, 0)
        for batch in batches:
            for row in batch.to_pylist():
                n_a, n_b, n_groups, size = _unzip(row["sizes"], "<i8").reshape(-1, 4).T
                keys, times = _unzip(row["keys"], "<i8"), _unzip(row["times"], "<u4").astype(np.int64)
                distinct, at = np.unique(keys, return_inverse=True)
                n = counts.of(distinct)[at]
                top = times * (n == best[np.minimum(keys >> 32, len(best) - 1)])
                ends = np.append(0, np.cumsum(size))
                n_best, count_sum = (np.diff(np.append(0, np.cumsum(x))[ends]) for x in (top, times * n))
                arrays = [pa.array(row["doc_ids"], pa.int64()), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum)], pa.array(row["digests"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(row["groups"], pa.string())] if groups else []), names=[c.split()[0] for c in schema.split(", ")])

    out = stage_mapped(spelt.mapInArrow(run, schema), "aligned")
    drop(docs, counts)
    release(spelt)
    return out
