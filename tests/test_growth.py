"""Figures and paths that only tables larger than the tests' would reach."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolake import catalog
from foliolake.functions import text as ft
from foliolake.functions import vectors as fv
from foliolake.operators import graph as g
from foliolake.operators import metrics as m
from foliolake.operators import quality as q
from foliolake.sources.tables import stage
from tests.conftest import SF


def test_exposition_writes_large_sums_without_exponent(spark):
    sums = []
    for seconds in (96_000_000.0, 12_345_678.5, 0.25, 3.0):
        requests = spark.createDataFrame([("a", "success", seconds)], "provider string, status string, seconds double")
        lines = m.exposition(requests, spark.createDataFrame([], "reason string")).where(F.contains("line", F.lit("_sum "))).collect()
        sums.append(lines[0]["line"].split(" ")[1])
    assert sums == ["96000000", "12345678.5", "0.25", "3"]


def _random_entries(spark, seed, n=60):
    """Entries with repeated paths, null and missing tags, links between them and to nothing."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        tags = None if rng.random() < 0.1 else [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(4))]
        rows.append((f"{rng.choice(['', '', 'wiki/'])}p{rng.randrange(n)}", tags, [f"p{rng.randrange(2 * n)}" for _ in range(rng.randrange(3))], [f"p{rng.randrange(n)}"] if rng.random() < 0.2 else None))
    return spark.createDataFrame(rows, "path string, tags array<string>, related array<string>, contradictions array<string>")


@pytest.mark.parametrize("seed", [2])
def test_groups_tell_what_the_edges_tell(spark, seed):
    e = _random_entries(spark, seed)
    edges = stage(g.build_graph(e), "edges")
    want = edges.groupBy("kind").agg(F.count("*"), F.countDistinct("src"))
    assert sorted(map(tuple, g.graph_totals(e).collect())) == sorted(map(tuple, want.collect()))
    start = edges.where("kind = 'tag_cooccurrence'").first()["src"]
    assert sorted(map(tuple, g.neighbours_of(e, start).collect()), key=str) == sorted(map(tuple, g.neighbours(edges, start).collect()), key=str)
    assert sorted(map(tuple, g.detect_communities(g.tag_graph(e), 3).collect())) == sorted(map(tuple, g.detect_communities(edges, 3).collect()))


def test_a_tag_set_of_many_entries(spark):
    # 20,000 entries with one tag set have 4e8 tag edges, which are counted and followed, not made.
    n = 20_000
    e = spark.range(n).selectExpr("concat('e', id) as path", "concat('t', id) as title", "'d' as domain", "'l1' as level", "array('x', 'y', if(id % 2 = 0, 'z', null)) as tags", "cast(array() as array<string>) as related", "cast(array() as array<string>) as contradictions")
    assert g.graph_totals(e).collect() == [("tag_cooccurrence", n * (n - 1), n)]
    assert g.graph_counts(e).collect() == [(n, n * (n - 1))]
    assert g.neighbours_of(e, "e5").groupBy("hop").count().orderBy("hop").collect() == [(0, 1), (1, n - 1)]
    assert [(r.domain, r["size"]) for r in g.aggregate_entries(e, g.detect_communities(g.tag_graph(e))).collect()] == [("d", n)]


def test_vector_search_many_equals_the_expression(spark):
    rng = np.random.default_rng(3)
    odd = [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [1.0] * 5, [float("nan")] * 8, [1.0] * 8, [1.0] * 8, [2.0] * 8]
    v = spark.createDataFrame([(f"v{k}", x) for k, x in enumerate(odd + rng.normal(size=(300, 8)).round(1).tolist())], "path string, vector array<float>").repartition(3)
    asked = v.where("path < 'v2'").select(F.col("path").alias("query_id"), F.col("vector").alias("q"))
    every = asked.crossJoin(v).select("query_id", "path", fv.cosine(F.col("vector"), F.col("q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    for k in (0, 1, 4, 400):
        want = every.withColumn("rank", rank).where(F.col("rank") <= k)
        assert sorted(map(tuple, fv.vector_search_many(v, asked, k).collect())) == sorted(map(tuple, want.collect()))


def test_vector_search_many_makes_no_row_for_each_pair(spark):
    # 2,000 queries over 20,000 vectors are 4e7 pairs; their expressions, 64 numbers long, took minutes.
    v = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(F.col("id") * k)).cast("array<float>").alias("vector")).withColumn("path", F.concat(F.lit("v"), "id"))
    began = time.time()
    found = fv.vector_search_many(v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 1)
    assert found.where("path = concat('v', query_id)").count() == 2_000 and time.time() - began < 60


def test_drift_pairs_are_not_sorted_as_a_whole(spark):
    plan = catalog.QUERIES["drift_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "REPARTITION_BY_NUM" in plan


def test_terms_are_counted_where_their_rows_are(spark):
    rows = [(f"p{k}", None if k % 7 == 0 else " ".join(f"w{k * j % 11}" for j in range(1 + k % 5))) for k in range(40)]
    docs = spark.createDataFrame(rows, "path string, body string").repartition(3)
    counts = ft.term_counts(docs)
    assert "hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()
    want = {(p, w): (b.split().count(w), len(b.split())) for p, b in rows if b for w in b.split()}
    assert {(r.path, r.term): (r.n, r.total) for r in counts.collect()} == want
    norms = ft.tfidf_weights(docs).groupBy("path").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(norms) == len({p for p, _ in want}) and all(abs(r.s - 1) < 1e-9 for r in norms)


def test_postings_are_placed_without_lambdas(spark):
    rows = [(f"p{k}", "a b" if k % 3 else None, ["x", "é", "x"], None if k % 7 == 0 else " ".join(f"w{k * j % 5}." for j in range(k % 9))) for k in range(1300)]
    docs = spark.createDataFrame(rows, "path string, title string, tags array<string>, body string").withColumn("domain", F.lit("d")).coalesce(1)
    postings, lengths = ft.rebuild_index(docs)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    want, sizes = {}, {}
    for path, title, tags, body in rows:
        for field, text in (("title", title or path), ("tags", " ".join(tags)), ("body", body or "")):
            cut = [t for w in text.split() for t in ([w[:-1], "."] if w.endswith(".") else [w])]
            sizes[path, field] = len(cut)
            for at, t in enumerate(cut):
                want.setdefault((t, field, path), []).append(at)
    found = postings.collect()
    assert len(found) == len(want) and {(r.term, r.field, r.path): list(r.positions) for r in found} == want and all(r.tf == len(r.positions) for r in found)
    assert {(r.path, r.field): r.len for r in lengths.collect()} == sizes


def test_tiles_of_tag_sets_are_sent_on_one_side_only(spark, monkeypatch):
    e = _random_entries(spark, 7, 80).withColumn("path", g.node_path(F.col("path")))
    want = sorted(map(tuple, g.tag_pairs(e).collect()))
    monkeypatch.setattr(g, "TILE", 3)
    small = g.tag_pairs(e)
    assert sorted(map(tuple, small.collect())) == want and len(want) > 300
    # What is dealt out anew has the paths of one tile; those of the other are sent once, not with each pair.
    assert re.search(r"RepartitionByExpression \[b#\d+, tile_b#\d+\]", small._jdf.queryExecution().optimizedPlan().toString())


def test_drift_tiles_keep_floats_and_are_compared_in_parts(spark, monkeypatch):
    kinds, stage_ = [], q.stage
    monkeypatch.setattr(q, "stage", lambda df, label: (kinds.append(df.schema["rows"].dataType.elementType["vector"].dataType.elementType.simpleString()), stage_(df, label))[1])
    rng = np.random.default_rng(5)
    e = spark.range(40).selectExpr("concat('p', id) as path", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id * 30 as int)) as created", "array('x', concat('t', id % 2)) as tags")
    for kind in ("float", "double"):
        v = spark.createDataFrame([(f"p{k}", x) for k, x in enumerate(rng.normal(size=(40, 4)).tolist())], f"path string, vector array<{kind}>")
        assert q.drift_pairs(e, v).count() > 100
    assert kinds == ["float", "double"]
    rows = [{"path": f"p{k:02d}", "at": k * 86400 * 40, "tags": ["a", "b"][k % 2 :], "vector": [float(x) for x in rng.normal(size=3)]} for k in range(20)]
    tile = pa.array(rows, pa.struct([("path", pa.string()), ("at", pa.int64()), ("tags", pa.list_(pa.string())), ("vector", pa.list_(pa.float32()))]))
    pairs = lambda same: [tuple(r.values()) for b in q._drifted("b", tile, tile, same, 0.6, 90) for r in b.to_pylist()]
    whole = [pairs(same) for same in (True, False)]
    monkeypatch.setattr(q, "ROWS_COMPARED", 3)
    parts = [pairs(same) for same in (True, False)]
    assert [[x[:4] for x in p] for p in whole] == [[x[:4] for x in p] for p in parts] and len(whole[0]) > 20
    assert np.allclose([x[4] for p in whole for x in p], [x[4] for p in parts for x in p])
