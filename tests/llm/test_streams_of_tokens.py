"""Mixing, packing and shards."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import mixing, packing, queries, shards, tokens

ODD = ["Hello <|endoftext|> wörld", "ÀÉ café's i'll don't ²x 12ab__c", "a b\x1cc", "İstanbul Σας ﬁ é", "", None, "日本語 text", "it's,they've 'd'x", "x" * 5000, "the cat " * 4000, " \n ", "a!!! b... c--d $$$ 9,9"]


def _plain(text):
    from tokenizers import Tokenizer

    if not hasattr(_plain, "t"):
        _plain.t = Tokenizer.from_file(tokens.default_tokenizer())
    return np.array([*(_plain.t.encode(text, add_special_tokens=False).ids if text else []), 1], "<u4")


def test_encoder_equals_the_tokenizer():
    e = tokens.Encoder(tokens.default_tokenizer())
    assert e.by_piece
    for t in ODD:
        assert np.frombuffer(e.encoded([t])[0], e.dtype).tolist() == _plain(t)[:-1].tolist(), t


def test_packing_round_trip(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(None, "no id", "y", 2), (3, ODD[3], "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, part string, ids int")).toPandas()
    got = got.sort_values(["sequence_id", "offset"])
    for _, seq in got.groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all()
        held = seq.length.sum()
        assert (seq.sequence_tokens == held).all() and (seq.padded_to == (held if held & (held - 1) == 0 else 2048)).all()
    assert (got.groupby("sequence_id").length.sum()[:-1] == 2048).all()
    for k, t in enumerate(ODD):
        own = got[got.doc_id == k].drop_duplicates(["start"]).sort_values("start")
        ids = _plain(t)
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        if k != 3:
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    assert got.doc_id.isna().sum() == 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = shards.Feistel(n, 9)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.number(slots) == np.arange(n)).all()
    assert n < 100 or (slots != shards.Feistel(n, 10).slot(np.arange(n))).any()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 3)], "doc_id long, text string")
    path = f"file://{tmp_path}/shards"
    plan = shards.write_shards(docs, path, per_shard=4, window=512)
    n, total = plan["sequences"], plan["tokens"]
    m = shards.manifest(spark, path).toPandas().sort_values("slot")
    assert m.slot.tolist() == list(range(n)) and sorted(m.sequence_id) == list(range(n)) and m.n_tokens.sum() == total
    packed = packing.pack(docs, window=512).toPandas().sort_values(["sequence_id", "offset"])
    docs_of = packed.groupby("sequence_id").doc_id.apply(lambda x: list(dict.fromkeys(x)))
    assert all(list(r.doc_ids) == docs_of[r.sequence_id] for r in m.itertuples())
    whole = {r.slot: r.ids for r in shards.read_slots(spark, path, 0, n).collect()}
    tail = shards.read_slots(spark, path, 3, 4).collect()
    assert [r.slot for r in tail] == [3, 4, 5, 6] and all(whole[r.slot] == r.ids for r in tail)
    assert all(zlib.crc32(np.frombuffer(whole[r.slot], "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in m.itertuples())
    empty = f"file://{tmp_path}/empty"
    assert shards.write_shards(docs.limit(0), empty)["sequences"] == 0 and shards.manifest(spark, empty).count() == 0


def test_shards_hold_the_tokenizers_ids_slot_by_slot(spark, tmp_path):
    # Documents in one partition keep their order, so the stream can be made by hand; repeats, a null id and columns that clash.
    rows = [(k % 7 if k % 7 else None, t, "x", k) for k, t in enumerate([*ODD, "the cat " * 3000, ODD[0], ODD[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, shard int").coalesce(1)
    path = f"file://{tmp_path}/shards"
    plan = shards.write_shards(docs, path, per_shard=3, window=256)
    stream = np.concatenate([_plain(t) for _, t, _, _ in rows])
    assert plan["tokens"] == len(stream) and plan["sequences"] == -(-len(stream) // 256)
    order = shards.Feistel(plan["sequences"], plan["key"])
    want = {int(order.slot(np.array([k]))[0]): stream[256 * k : 256 * k + 256] for k in range(plan["sequences"])}
    files = sorted((tmp_path / "shards").glob("part-*"))
    assert len(files) == -(-plan["sequences"] // 3)
    for s, ids in want.items():  # arithmetic alone, as another program would read it
        raw = files[s // 3].read_bytes()[s % 3 * plan["record"] :][: plan["record"]]
        assert int.from_bytes(raw[:8], "little") == s and int.from_bytes(raw[8:12], "little") == len(ids) and raw[-1:] == b"\n"
        assert np.frombuffer(raw[12 : 12 + 2 * len(ids)], "<u2").tolist() == ids.tolist()
        assert set(raw[12 + 2 * len(ids) : -1]) <= {0}
    for first, count in ((0, 1), (2, 5), (plan["sequences"] - 1, 9)):
        assert [x.tolist() for x in shards.seek(spark, path, first, count)] == [want[s].tolist() for s in range(first, min(first + count, plan["sequences"]))]


def test_shards_go_on_where_a_run_was_cut_off(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 2)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/shards"
    plan = shards.write_shards(docs, path, per_shard=4, window=512)
    before = {f.name.split("-")[1]: (f.name, f.read_bytes()) for f in (tmp_path / "shards").glob("part-*")}
    lost = sorted(before)[::3]
    for k in lost:
        (tmp_path / "shards" / before[k][0]).unlink()
    assert shards.write_shards(docs, path, per_shard=4, window=512) == plan
    after = {f.name.split("-")[1]: (f.name, f.read_bytes()) for f in (tmp_path / "shards").glob("part-*") if f.stat().st_size}
    assert {k: v[1] for k, v in after.items()} == {k: v[1] for k, v in before.items()}
    assert {k for k in after if after[k][0] != before[k][0]} == set(lost)
    with pytest.raises(ValueError, match="another layout"):
        shards.write_shards(docs, path, per_shard=8, window=512)


def _whole_shards(folder):
    return {f.name.split("-")[1]: f.read_bytes() for f in folder.glob("part-*") if f.stat().st_size}


def test_a_resumed_run_keeps_the_first_runs_order_under_other_splits(spark, tmp_path):
    texts = [f"{t or ''} number {k} " * 9 for k, t in enumerate(ODD * 12)]
    for half in (0, 1):
        spark.createDataFrame([(k, t) for k, t in enumerate(texts) if k % 2 == half], "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).mode("append").parquet(f"{tmp_path}/docs")
    path, before = tmp_path / "shards", spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = lambda: spark.read.parquet(f"{tmp_path}/docs")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        plan = shards.write_shards(docs(), f"file://{path}", per_shard=4, window=256)
        first, held = _whole_shards(path), sorted(map(str, spark.read.parquet(f"{path}/_documents").collect()))
        assert len(first) > 6
        for k, f in enumerate(sorted(path.glob("part-*"))):
            if k % 2:
                f.unlink()
        splits = docs().rdd.getNumPartitions()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert docs().rdd.getNumPartitions() > splits
        assert shards.write_shards(docs(), f"file://{path}", per_shard=4, window=256) == plan
        assert _whole_shards(path) == first
        assert sorted(map(str, spark.read.parquet(f"{path}/_documents").collect())) == held
        changed = docs().withColumn("text", F.when(F.col("doc_id") == 7, "quite another text").otherwise(F.col("text")))
        with pytest.raises(ValueError, match="other rows"):
            shards.write_shards(changed, f"file://{path}", per_shard=4, window=256)
        # Without the kept stream another order is noticed, and the same one goes on.
        shards.drop_tokens(spark, f"file://{path}")
        next(path.glob("part-*")).unlink()
        with pytest.raises(ValueError, match="another order"):
            shards.write_shards(docs(), f"file://{path}", per_shard=4, window=256)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert shards.write_shards(docs(), f"file://{path}", per_shard=4, window=256, keep_tokens=False) == plan
        assert _whole_shards(path) == first and not (path / "_tokens").exists()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _sources(seed=2, n=400):
    r = random.Random(seed)
    names = ["b", "a", None, "Z", "é", "hot", "hot", "hot"]
    return [(None if k % 97 == 0 else k, None if k % 50 == 3 else " ".join(["w"] * r.choice([0, 1, 5, 30, 200])) + f" {k}", r.choice(names), "x", 1.5) for k in range(n)]


def test_mix_equals_sql_and_meets_targets(spark):
    rows = [r for r in _sources() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank double")
    got = mixing.allocation(df).toPandas()
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas())
    want = con.sql(queries._OP1).df().set_index("doc_id")
    got["taken"] = got["size"] * got["copies"]
    got = got.set_index("doc_id")
    for c in ("size", "source_size", "target", "taken"):
        assert (got[c].sort_index() == want[c].sort_index()).all(), c
    assert got.copies.max() <= 3
    per = got.groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
    assert (abs(per.taken - per.target) <= 0.03 * per.target + 5).all()
    assert abs(per.target.sum() - got["size"].sum()) < 1e-6


def test_mix_of_odd_rows(spark):
    rows = [*_sources(), *[(5, "same text here", "hot", "x", 2.0)] * 4]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank double")
    once, again = (mixing.mix(df.repartition(k)) for k in (2, 5))
    assert once.columns == df.columns
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (once, again))
    assert a == b and set(a) <= set(map(tuple, df.collect()))
    assert len(a) == mixing.allocation(df).agg(F.sum("copies")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.allocation(df.limit(0)).count() == 0
    assert mixing.allocation(df, preference="rank").agg(F.max("copies")).first()[0] <= 3


def test_inclusion_is_as_frequent_as_its_odds(spark):
    r = random.Random(5)
    sizes = [r.choice([1, 3, 9, 40, 200]) for _ in range(100)]
    rows = [(100 * g + k, " ".join(["w"] * n), f"s{g:03d}") for g in range(90) for k, n in enumerate(sizes)]  # 30 sources of each weight, alike in sizes
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    every, plan = mixing.allocation_plan(df, 1, (1, 2, 3), 3, None)
    got = mixing._decided(mixing._ranked(every, plan, 3)).select("doc_id", "wanted", "size", "target", "source", "copies").toPandas()
    # Before anything is drawn the expected words are the target's, none beyond three copies, longer texts likelier.
    assert (abs((got.wanted * got["size"]).groupby(got.source).sum() - got.groupby("source").target.first()) < 1e-6).all()
    assert got.wanted.max() <= 3 and got.wanted.round(6).nunique() >= 10
    for _, part in got.groupby(got.wanted.round(6)):
        assert abs(part.copies.mean() - part.wanted.iloc[0]) < 5 * 0.5 / np.sqrt(len(part)) + 0.03


def test_preference_is_reshared_beyond_the_cap(spark):
    rows = [(k, "w " * 10, "a", 100.0 if k < 5 else 1.0 if k < 90 else None if k < 95 else -1.0) for k in range(100)] + [(k, "w " * 10, "b", 1.0) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, p double")
    got = mixing.allocation(df, preference="p").toPandas()
    assert (got[got.doc_id < 5].copies == 3).all() and (got[(got.doc_id >= 95) & (got.doc_id < 100)].copies == 0).all()
    a = got[got.source == "a"]
    assert abs((a.copies * a["size"]).sum() - a.target.iloc[0]) <= 10


def test_targets_fill_up(spark):
    s = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t == {"a": 30.0, "b": 30.0, "c": 960.0, None: 0.0}
