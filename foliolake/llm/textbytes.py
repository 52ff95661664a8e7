"""Word, shingle and hash arithmetic on UTF-8 bytes, a whole Arrow batch at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only; both rules are byte rules, so UTF-8 text
never has to be decoded.  Hashes are 64-bit and defined here alone: they do not depend on the platform,
the process or the batch a text arrives in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed in one numpy pass: bounds the scratch arrays to some tens of MB whatever the texts are.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) * U64(0xD1342543DE82EF95) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


_BYTE = seeded(11, 256)[_LOWER]
_STEP = seeded(12, 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=U64), np.full(n, inverse, dtype=U64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_UP, _DOWN = _powers(1 << 16)


def _words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one byte array."""
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_SPACE[raw]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, independent of where the word stands."""
    out = np.zeros(len(starts), dtype=U64)
    step = len(_UP)
    if not len(raw):
        return out
    values = _BYTE[raw]
    # Within blocks of `step` bytes a running sum of value * base**position gives every word by one subtraction.
    n = len(raw)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    at = np.arange(n, dtype=np.int64) & (step - 1)
    with np.errstate(over="ignore"):
        np.cumsum(values * _UP[at], dtype=U64, out=sums[1:])
        same = (starts // step) == ((ends - 1) // step)
        s, e = starts[same], ends[same]
        out[same] = mix((sums[e] - sums[s]) * _DOWN[s & (step - 1)] + _STEP[0] * (e - s).astype(U64))
        for k in np.flatnonzero(~same):  # a word across a block's border, or a huge one
            s, e = int(starts[k]), int(ends[k])
            total, scale = 0, 1
            for a in range(s, e, step):
                part = values[a : min(e, a + step)]
                total += scale * int((part * _UP[: len(part)]).sum(dtype=U64))
                scale = scale * pow(_BASE, step, 1 << 64) % (1 << 64)
            out[k] = mix(np.array([(total + int(_STEP[0]) * (e - s)) % (1 << 64)], dtype=U64))[0]
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes, valid) of a string or binary Arrow array, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), dtype=bool)
    return at, raw, valid


def chunks(at: np.ndarray, size: int = CHUNK):
    """Ranges of rows of about `size` bytes; a longer row stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, min(last, len(at) - 1)
        first = min(last, len(at) - 1)


def word_hashes(column: pa.Array):
    """Yields (first row, last row, word hashes, words' row borders) for runs of rows; nulls have no words."""
    at, raw, valid = buffers(column)
    for first, last in chunks(at):
        part = raw[at[first] : at[last]]
        starts, ends = _words_of(part)
        rows = at[first : last + 1] - at[first]
        # A word may not run on into the next text.
        inner = rows[1:-1]
        k = np.searchsorted(starts, inner, side="left") - 1
        cut = (k >= 0) & (inner > 0) & (inner < len(part))
        cut[cut] = (ends[k[cut]] > inner[cut]) & (starts[k[cut]] < inner[cut])
        if cut.any():
            more = np.unique(inner[cut])
            starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
        hashes = _hash_words(part, starts, ends)
        borders = np.searchsorted(starts, rows, side="left")
        if not valid[first:last].all():
            keep = np.repeat(valid[first:last], np.diff(borders))
            hashes = hashes[keep]
            borders = np.concatenate([[0], np.cumsum(np.where(valid[first:last], np.diff(borders), 0))])
        yield first, last, hashes, borders


def shingles(hashes: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each row (fewer words: the whole row), and the rows' borders."""
    counts = np.diff(borders)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(out_at[-1], dtype=U64)
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            run = hashes[: len(hashes) - width + 1] * _STEP[1]
            for j in range(1, width):
                run = run + hashes[j : len(hashes) - width + 1 + j] * _STEP[1 + j]
            run = mix(run)
            long = counts >= width
            take = np.repeat(borders[:-1][long], n[long]) + _ranges(n[long])
            out[np.repeat(long, n)] = run[take]
        for k in np.flatnonzero((counts > 0) & (counts < width)):
            h = hashes[borders[k] : borders[k + 1]]
            out[out_at[k]] = mix(np.array([(h * _STEP[1 : 1 + len(h)]).sum(dtype=U64) + _STEP[10] * U64(len(h))], dtype=U64))[0]
    return out, out_at


def _ranges(n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def distinct_per_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the rows' borders."""
    parts, n = [], np.zeros(len(at) - 1, dtype=np.int64)
    for k in range(len(at) - 1):
        if at[k + 1] > at[k]:
            v = np.sort(values[at[k] : at[k + 1]])
            if len(v) > 1:
                v = v[np.concatenate([[True], v[1:] != v[:-1]])]
            parts.append(v)
            n[k] = len(v)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U64)), np.concatenate([[0], np.cumsum(n)])
