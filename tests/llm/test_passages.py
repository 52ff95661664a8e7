"""Repeated passages and the radix sort under them, against brute force and SQL."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import queries, suffixes
from tests.conftest import SF


def brute_repeats(rows, threshold):
    """doc_id to (bytes, bytes that go, runs that go, digest of the rest), window by window."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - threshold + 1):
            if raw[s : s + threshold] in seen:
                gone[s : s + threshold] = b"\1" * threshold
            seen.add(raw[s : s + threshold])
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def _result(df):
    return df.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()


def _passages(seed, n=120):
    r = random.Random(seed)
    shared = ["".join(r.choice("abé ") for _ in range(r.randint(5, 60))) for _ in range(12)]
    text = lambda: "".join(r.choice(shared) if r.random() < 0.6 else "".join(r.choice("xyzw") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 12)))
    return [(k, text(), "clash", k) for k in range(n)] + [(500, "q" * 300, "", 0), (501, None, "", 0), (502, "q" * 90, "", 0), (503, "", "", 0)]


@pytest.mark.parametrize("hot", [512, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, hot):
    rows = _passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, m int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in _result(suffixes.without_repeats(df, threshold=20, gram=9, hot=hot))}
    assert got == brute_repeats([r[:2] for r in rows], 20)


def test_passes_and_chunks_do_not_show(spark, monkeypatch):
    rows = [r[:2] for r in _passages(7)] + [(600, "".join(random.Random(4).choice("ab") for _ in range(3000)))]
    run = lambda: {r[0]: tuple(r[1:]) for r in _result(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=30, gram=12))}
    whole = run()
    assert whole == brute_repeats(rows, 30)
    # In the driver's process alone: the same runs, cut at other places, are still the same windows.
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])
    windows = lambda: sorted((int(r), s + j) for rows_, e in suffixes.runs_of_windows(raw, at, 30, 12, np.zeros(0, np.uint64)) for r, s0, m in zip(rows_, e["start"], e["m"]) for s, j in ((int(s0), j) for j in range(int(m))))
    every = [(k, s) for k in range(len(at) - 1) for s in range(max(0, int(at[k + 1] - at[k]) - 29))]
    assert windows() == every
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    assert windows() == every


def test_radix_sort_finds_exactly_the_equal_windows():
    r = np.random.default_rng(3)
    raw = r.integers(0, 2, 4000).astype(np.uint8)
    at = np.arange(len(raw) - 25)
    for width in (8, 13, 21):
        alive, group = suffixes.equal_windows(raw, at, np.zeros(len(at), np.int64), width)
        by = {}
        for k in at:
            by.setdefault(raw[k : k + width].tobytes(), []).append(int(k))
        want = sorted(v for v in by.values() if len(v) > 1)
        got = {}
        for k, g in zip(alive.tolist(), group.tolist()):
            got.setdefault(g, []).append(k)
        assert sorted(sorted(v) for v in got.values()) == want


def test_odd_rows(spark):
    a, b = "the first of two passages here " * 5, "another one, told only once " * 6
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (3, b), (3, a + b), (None, None), (4, "é" * 30)]
    got = sorted(_result(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert len(got) == len(rows) and by[1][0] == by[1][1]  # rows of one id and text: one document
    assert by[2][0][2] == len(a) and by[2][0][3] == 1  # a copy goes whole
    assert {r[2] for r in by[None]} == {0, len(a), len(b)}  # after all others
    assert sum(r[2] for r in by[3]) >= len(a)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="gram"):
        suffixes.without_repeats(empty, threshold=20, gram=20)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.op13_suffix_radix_dedup(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op13_suffix_radix_dedup"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
