"""Tables in parts and the stored Merkle tree: right results, and only what changed is written."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliolake.operators import merkle
from foliolake.sources.parts import PartTable


def _times(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_an_upsert_writes_the_parts_it_touches(spark, tmp_path):
    rows = [(f"k{k}", k, [k]) for k in range(2000)]
    table = PartTable.create(spark.createDataFrame(rows, "key string, n long, l array<long>"), f"file://{tmp_path}/t", "key", parts=64)
    before = _times(tmp_path / "t")
    written = table.put(spark.createDataFrame([(f"k{k}", -k, []) for k in range(0, 2000, 200)] + [(None, 1, None)], "key string, n long, l array<long>"))
    after = _times(tmp_path / "t")
    kept = [p for p in before if after.get(p) == before[p]]
    assert len(written) <= 10 and len(before) == 64 and len(kept) == 64 - len(written)
    want = {k: -n if n % 200 == 0 else n for k, n, _ in rows}
    assert {r.key: r.n for r in PartTable(spark, table.path).read().collect()} == want
    assert [tuple(r) for r in table.get("k200").collect()] == [("k200", -200, [])] and table.get("none").isEmpty()
    table.put(spark.createDataFrame([("new", 5, None), ("new", 7, None)], "key string, n long, l array<long>"))
    assert [r.n for r in table.get("new").collect()] == [7]
    gone = [f"k{k}" for k in range(50)]
    table.drop(spark.createDataFrame([(k,) for k in [*gone, None, "unknown"]], "key string"))
    assert {r.key for r in table.read().collect()} == {*want, "new"} - set(gone)


def test_a_part_without_rows_goes(spark, tmp_path):
    table = PartTable.create(spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int"), f"file://{tmp_path}/t", "key", parts=512)
    assert len(_times(tmp_path / "t")) == 2
    assert len(table.drop(spark.createDataFrame([("a",)], "key string"))) == 1
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)] and table.drop(spark.createDataFrame([], "key string")) == []
    with pytest.raises(FileNotFoundError):
        PartTable(spark, f"file://{tmp_path}/none")


def _frame(spark, state):
    return spark.createDataFrame(sorted(state.items()), "path string, source_hash string")


@pytest.mark.parametrize("depth", [1, 3])
def test_changed_paths_equal_an_anti_join(spark, tmp_path, depth):
    r = random.Random(depth)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = {f"raw/{k}.pdf": sha(f"v{k}") for k in range(1500)}
    a = merkle.Tree.build(_frame(spark, first), f"file://{tmp_path}/a", depth)
    same = merkle.Tree.build(_frame(spark, first).repartition(5), f"file://{tmp_path}/same", depth)
    assert a.root_hash() == same.root_hash()
    rows, read = merkle.compare(a, same)
    assert rows.count() == 0 and read == 2
    changes = {p: sha("new" + p) for p in r.sample(sorted(first), 3)} | {"raw/x.pdf": sha("x"), "raw/y.pdf": None, "raw/7.pdf": None}
    before = _times(tmp_path / "same/nodes") | _times(tmp_path / "same/leaves")
    written = same.update(_frame(spark, changes))
    after = _times(tmp_path / "same/nodes") | _times(tmp_path / "same/leaves")
    second = {k: v for k, v in (first | changes).items() if v is not None}
    assert written <= len(changes) * (depth + 1) and (depth < 2 or sum(after.get(p) == t for p, t in before.items()) > 200)
    # An updated tree is the one that is built anew.
    anew = merkle.Tree.build(_frame(spark, second), f"file://{tmp_path}/anew", depth)
    nodes = lambda t: sorted(map(tuple, t.nodes().select("level", "prefix", "hash", "n").collect()))
    assert nodes(same) == nodes(anew) and same.root_hash() == anew.root_hash() != a.root_hash()
    rows, read = merkle.compare(a, same)
    x, y = set(first.items()), set(second.items())
    want = {p: "changed" if p in first and p in second else "added" if p in second else "removed" for p, _ in x ^ y}
    assert dict(map(tuple, rows.collect())) == want
    assert read < 2 * a.nodes().count() or depth == 1


def test_trees_without_leaves(spark, tmp_path):
    none = spark.createDataFrame([(None, "h")], "path string, source_hash string")
    empty = merkle.Tree.build(none, f"file://{tmp_path}/none", 1)
    one = merkle.Tree.build(spark.createDataFrame([("p", None)], "path string, source_hash string"), f"file://{tmp_path}/one", 1)
    assert empty.root_hash() is None and one.root_hash()
    assert [tuple(r) for r in merkle.compare(empty, one)[0].collect()] == [("p", "added")]
    assert one.update(spark.createDataFrame([("p", None)], "path string, source_hash string")) == 0 and one.root_hash() is None
    assert empty.update(none) == 0
    with pytest.raises(ValueError, match="depths"):
        merkle.compare(empty, merkle.Tree.build(none, f"file://{tmp_path}/deep", 2))


def _rows_scanned(df):
    """Rows that the scan of a collected df handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_a_lookup_skips_row_groups(spark, tmp_path):
    from foliolake.sources.relational import read_table, write_table

    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("s").alias("schema_name"), F.lit("{}").alias("data"), F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(9999))).alias("source_file"))
    write_table(rows.coalesce(1), f"file://{tmp_path}", "extracted_documents", distinct=10_000, group_bytes=200_000)
    table = read_table(spark, f"file://{tmp_path}", "extracted_documents")
    one = table.where(F.col("id") == hashlib.sha256(b"77").hexdigest()).select("id", "source_file")
    assert len(one.collect()) == 1 and _rows_scanned(one) < 20_000
    every = table.select("id", "source_file")
    assert len(every.collect()) == 40_000 and _rows_scanned(every) == 40_000
    with pytest.raises(ValueError, match="no columns"):
        write_table(rows.withColumn("odd", F.lit(1)), f"file://{tmp_path}", "extracted_documents")


def test_statistics_of_mixed_metadata(spark):
    from foliolake.operators.metrics import extraction_statistics
    from foliolake.sources.relational import conformed

    metas = ['{"processing_time_ms": 12}', '{"processing_time_ms": "15"}', '{"processing_time_ms": 12.7}', '{"processing_time_ms": true}', '{"processing_time_ms": {"a": 1}}', '{"processing_time_ms": null}', "{broken", "", None, "[1]", '{"other": 1}', '{"processing_time_ms": -3}']
    df = spark.createDataFrame([("a" if k % 2 else "b", t, "1") for k, t in enumerate(metas)], "schema_name string, extraction_metadata string, data string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    text, variant = (sorted(map(tuple, extraction_statistics(x, now).collect())) for x in (df, conformed(df, "extracted_documents")))
    assert text == variant and {r[0]: r[4] for r in text} == {"b": 12.0, "a": 6.0}
