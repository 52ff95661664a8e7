"""What is held at once, and what is made more than once."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliolake.functions import layout as fl
from foliolake.functions import text as ft
from foliolake.functions import topk as tk
from foliolake.operators import graph as g
from foliolake.streaming import alerts as al
from foliolake.streaming import streams as ss


def test_regions_are_parsed_once(spark):
    texts = spark.createDataFrame([(1, "title [1, 2, 3, 4] and [5,6,7,8]"), (2, "none"), (3, None)], "id long, t string")
    rows = fl.region_rows(texts.select("id", fl.parse_layout_text(F.col("t")).alias("r")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r["id"], r["content"]) for r in rows.orderBy("id", "x").collect()] == [(1, "[1, 2, 3, 4]"), (1, "[5,6,7,8]")]


def test_names_are_not_broadcast(spark):
    names = spark.createDataFrame([(f"Name#{k:05d}",) for k in range(50)], "name string")
    pairs = ft.similar_names(names, names, 0.2)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 50 * 49


def test_waiting_rows_take_little_room_and_keep_their_order():
    n = 200_000
    rows = ((float(k * 7919 % n), f"m{k % 3}", None if k % 2 else "high") for k in range(n))
    tracemalloc.start()
    at, kind, kinds = al.waiting_rows(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * n and len(kinds) == 6
    assert np.all(np.diff(at) >= 0)
    some = [(2.0, "b", "x"), (1.0, "b", "y"), (1.0, "a", "z"), (2.0, "b", "w")]
    assert list(al._rows(*al.waiting_rows(some), 0, 4)) == sorted(some)
    assert al.waiting_rows([])[0].tolist() == []


def test_outcomes_one_by_one_are_those_of_the_rules():
    rows = [(float(k * 3), f"m{k % 4}", "high") for k in range(60)]
    told, state = ss.alert_rules(rows)
    own = {"last": None, "alerts": []}
    assert [(*r, *o) for r, o in zip(rows, ss.alert_outcomes(rows, own))] == told and own == state
    assert {x[3] for x in told} <= set(al.OUTCOMES)


def test_labels_are_not_broadcast(spark, monkeypatch):
    plans, stage = [], g.stage

    def noting(df, label, *more):
        if label == "labels":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label, *more)

    monkeypatch.setattr(g, "stage", noting)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    labels = {r["path"]: r["label"] for r in g.detect_communities(edges, 3).collect()}
    assert set(labels) == set("abcxy") and len(plans) > 1
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_postings_leave_their_paths_behind_at_once(spark):
    entries = spark.createDataFrame([(f"p{k}", "t", "d", ["x"], "a b c " * (k + 1)) for k in range(5)], "path string, title string, domain string, tags array<string>, body string")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tk.build_blocks(*ft.rebuild_index(entries))[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # The join on paths that lies last in the plan's order is that of postings with their documents, by path and field.
    last = next(line for line in plan.split("\n") if "SortMergeJoin [path" in line)
    assert "field" in last


def test_names_meet_in_blocks_and_not_by_trigram(spark):
    names = spark.createDataFrame([(f"Name#{k:05d}",) for k in range(40)], "name string")
    plan = ft.similar_names(names, names, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin [gram" not in plan


def test_pairs_of_names_across_blocks(monkeypatch):
    rng = random.Random(5)
    grams = lambda name: sorted({f"  {name} "[k : k + 3] for k in range(max(1, len(name)))})
    names = sorted({"".join(rng.choice("abc0") for _ in range(rng.randrange(9))) for _ in range(300)} | {"x" * 300 + f"{k}" * 3 for k in range(3)} | {"".join(map(chr, range(200, 500)))})
    monkeypatch.setattr(ft, "NAMES_HELD", 7)
    monkeypatch.setattr(ft, "NAMES_COUNTED", 3)
    rows = sorted((0, len(grams(x)), x, grams(x)) for x in names)
    schema = pa.schema([("side", pa.int32()), ("n", pa.int32()), ("name", pa.string()), ("g", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[s : s + 50]), schema)], schema=schema) for s in range(0, len(rows), 50)]
    blocks = [b.to_struct_array()[0] for b in ft._name_blocks(iter(batches))]
    assert max(len(b["names"].values) for b in blocks) == 7 and sum(len(b["names"].values) for b in blocks) == len(names)
    for least in (0.2, 0.5, 1.0):
        pairs = [(x, y) for k, x in enumerate(blocks) for y in blocks[k:]]
        got = [(r["left"], r["right"], r["similarity"]) for x, y in pairs for b in ft._alike(x, y, least, True, x is y) for r in b.to_pylist()]
        own = {x: set(grams(x)) for x in names}
        want = {(x, y, len(own[x] & own[y]) / len(own[x] | own[y])) for x in names for y in names if x < y and len(own[x] & own[y]) / len(own[x] | own[y]) >= least}
        assert len(got) == len(set(got)) and set(got) == want
