"""Exact top-k, and the pipeline, against brute force."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from foliolake.llm import pii, pivots, queries, toxicity
from tests.llm.test_groups import brute_groups
from tests.llm.test_streams_of_tokens import _plain

SF = "/root/testdata/sf0.001"


def _brute(rows, k, asks):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i in sorted({i for i, _ in ok if asks(i)}):
        q = min((v.tolist() for j, v in ok if j == i))
        scored = sorted((-int(np.dot(v, q)), j) for j, v in ok if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=12) * (k % 5)]) for k in range(300)]
    rows += [(10, rows[20][1]), (400, rows[20][1]), (401, rows[20][1]), (402, None), (403, [None] * 12), (404, [float("nan")] * 12), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == _brute(rows, 7, lambda i: i % 20 == 0)
    few = df.where("vec_id < 3")
    assert pivots.top_k(few, F.col("vec_id") == 0, k=7).count() == 2
    assert pivots.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0 and pivots.top_k(df, F.lit(False)).count() == 0


def _clustered(n=3000, spread=0.02):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, n)] + spread * rng.normal(size=(n, 16))
    return [(k, [float(np.float32(v)) for v in row / np.linalg.norm(row)]) for k, row in enumerate(x)]


def test_pivots_stop_early(spark, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 64)
    monkeypatch.setattr(pivots, "CHOSEN_FROM", 512)
    rows = _clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    asks = F.col("vec_id") % 100 == 0
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.top_k(df, asks).collect())
    assert got == _brute(rows, 10, lambda i: i % 100 == 0)
    looked = pivots.evaluated(df, asks).toPandas()
    assert len(looked) == 30 and looked.evaluated.sum() < 0.1 * len(rows) * len(looked)  # a query's own cluster is a 30th


def test_top_k_of_unequal_lengths_and_large_numbers(spark):
    rows = [(0, [1e6, -2.5]), (1, [1e6]), (2, [3.0, 4.0, 5.0]), (3, []), (4, [-1e6, 0.0, 1.0]), (20, [7.0]), (21, [1e6, -2.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect())
    filled = [(i, [*v, *[0.0] * (3 - len(v))] if v else v) for i, v in rows]
    assert got == _brute(filled, 3, lambda i: i % 20 == 0)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lex = toxicity.learn(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if lex.score(r.text) < toxicity.THRESHOLD]
    roots = brute_groups([(d, t) for d, t, _ in rows])[1]
    rows = [r for r in rows if roots[r[0]] == r[0]]
    clean = []
    for d, t, s in rows:
        base, added = pii.find(pa.array([t]), pii.trained())[0]
        out, at = "", 0
        for k, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += t[at:a] + f"<{k}>"
            at = max(at, b)
        clean.append((d, out + t[at:], s))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(clean, "doc_id long, text string, source string").toPandas())
    taken = {d: (z, n) for d, z, n in con.sql(f"select doc_id, size, taken from ({queries._OP1})").fetchall()}
    want = []
    for d, t, _ in clean:
        ids = _plain(t)
        size, n = taken[d]
        want += [(d, len(ids))] * (n // size if size else 0)
    got = corpus_pipeline.run(spark, SF).toPandas()
    first = got[got.start == 0]
    assert sorted(zip(first.doc_id, first.doc_tokens)) == sorted(want)
    assert got.length.sum() == sum(n for _, n in want)
    texts = {d: _plain(t) for d, t, _ in clean}
    assert all(zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got.itertuples())


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, SF)
            assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns
            now.count()


def test_near_duplicates_of_repeated_and_null_ids(spark):
    one, two, three = ("the quick brown fox jumps over lazy dogs", "an entirely different line of text stands here", "nobody else has written these few words yet")
    rows = [(1, one), (1, one), (None, one), (2, one), (None, two), (None, two), (3, three), (None, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.select("doc_id", "text", "n_chars").collect()), key=str) == sorted([(1, one, 0), (None, two, 4), (3, three, 6), (None, None, 7), (4, "", 8), (5, "", 9)], key=str)
