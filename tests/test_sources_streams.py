"""Files, snapshots, configuration, the engine's tools, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliolake.plans.engine import TOOLS, Engine, register_tool
from foliolake.sources import files as sf
from foliolake.sources import tables as st
from foliolake.sources import wiki as sw
from foliolake.streaming import streams as ss

PAGE = "---\ntitle: {t}\ndomain: IT\ntags: [a, b]\nrelated: [{r}]\ncreated: 2024-01-01\nupdated: 2024-01-01\n---\nAll about {t}.\n"


@pytest.fixture
def wiki(tmp_path):
    (tmp_path / "it").mkdir()
    (tmp_path / ".versions").mkdir()
    (tmp_path / "it" / "a b.md").write_text(PAGE.format(t="Rust+", r="wiki/it/c.md"))
    (tmp_path / "it" / "c.md").write_text(PAGE.format(t="Go", r="gone.md"))
    (tmp_path / "index.md").write_text(PAGE.format(t="Index", r=""))
    (tmp_path / "bad.md").write_text("---\nnope")
    (tmp_path / ".versions" / "c_v1.md").write_text(PAGE.format(t="Old", r=""))
    return tmp_path


def test_engine_on_a_wiki(spark, wiki, tmp_path):
    e = Engine.from_wiki(spark, str(wiki), root=f"file://{tmp_path}/.idx")
    assert sorted(r.path for r in e.entries.collect()) == ["it/a b.md", "it/c.md"]
    assert len(e.tools()) == 24 == len(TOOLS)
    assert [r.path for r in e.call("search_knowledge", query="Rust").collect()] == ["it/a b.md"]
    assert e.call("find_orphans").count() == 0 and e.call("check_quality").where("severity = 'error'").count() == 0
    assert {r.path for r in e.call("get_entry_context", path="it/a b.md").collect()} == {"it/c.md"}
    assert e.call("get_health_report").first().broken_link_count == 1
    assert e.call("suggest_links", path="it/c.md").count() == 0
    assert e.call("set_config", a="1", b="2") == {"a": "1", "b": "2"} and e.call("set_config", a=None) == {"b": "2"} and e.call("get_config", key="b") == "2"
    assert e.call("get_compile_status").first().message == "No compile has been performed yet."
    assert e.index() is None and e.call("rebuild_index")[0].count() > 0 and e.index() is not None
    assert [r.path for r in e.call("search_knowledge", query="Rust").collect()] == ["it/a b.md"]
    Engine(spark, e.entries.limit(0), root=e.root).call("search_knowledge", query="Rust").count()  # the saved index is what is read
    assert e.embed_entry("it/c.md").first().path == "it/c.md"
    assert e.call("get_health_report").first().index_bytes > 0
    register_tool("shout", lambda e, text: text.upper())
    assert e.call("shout", text="x") == "X" and TOOLS.pop("shout")
    with pytest.raises(KeyError):
        e.call("nothing")


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    made = lambda: spark.createDataFrame([("a", "b", "related")], "src string, dst string, kind string")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        st.load(spark, path)
    assert st.load(spark, path, made).count() == 1
    st.save(st.load(spark, path).unionByName(made()), path)
    assert st.load(spark, path).count() == 2
    assert st.load(spark, path, lambda: made().withColumn("w", F.lit(1)), ("w",)).count() == 1
    assert st.insert_missing(made(), made().withColumn("dst", F.lit("z")), "src").first().dst == "b"
    rows = spark.createDataFrame([("a", "x", 1), ("a", "z", 0), ("c", "q", 1), (None, "n", 1), (None, "n", 1)], "src string, dst string, w int")
    assert sorted(map(str, (tuple(r) for r in st.upsert(made(), rows, "src").collect()))) == sorted(map(str, [("a", "z", None, 0), ("c", "q", None, 1), (None, "n", None, 1), (None, "n", None, 1)]))


def test_a_save_that_was_cut_off_is_found_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    st.save(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # the old one has stepped aside, the new one is not there yet
    assert st.load(spark, path).count() == 3
    st.save(spark.range(5), path)
    assert st.load(spark, path).count() == 5 and not (tmp_path / "t.old").exists()


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Other:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        st.shared_dir(Other)
    Other.sparkContext.master = "local[4]"
    assert st.shared_dir(Other) == st.LOCAL


def test_batch_size_is_given_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), st.arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before


def test_compiling_files(spark, tmp_path):
    root, now = f"file://{tmp_path}/kb", F.expr("timestamp'2030-01-01 00:00:00'")
    files = spark.createDataFrame([("in/a b.pdf", bytearray("one\x0ctwo é".encode())), ("in/c.pdf", bytearray(b"x"))], "path string, content binary")
    first = sw.incremental_compile(files, root, now)
    assert {(r.path, r.action, r.error) for r in first.collect()} == {("in/a b.pdf", "compile", None), ("in/c.pdf", "compile", None)}
    raw = (tmp_path / "kb" / "raw" / "a b.md").read_text()
    assert raw.startswith("---\nsource_file: in/a b.pdf\nsource_name: a b\nfile_hash: ") and raw.endswith("## 正文\n\none\ntwo é") and "- 页数: 2\n- 质量: 0%" in raw
    assert "two é" in (tmp_path / "kb" / "raw" / "a b.compile_prompt.md").read_text() and "暂无词条" in (tmp_path / "kb" / "wiki" / "index.md").read_text()
    status = sw.cs.get_compile_status(spark, root).first()
    assert (status.entries_compiled, status.entries_skipped, status.last_outcome, status.last_finished) == (2, 0, "success", "2030-01-01T00:00:00Z")
    assert {r.action for r in sw.incremental_compile(files, root, now).collect()} == {"skip"}
    sf.register_extractor("picky", lambda raw: [raw.decode()] if raw != b"bad" else 1 / 0)
    worse = spark.createDataFrame([("in/a b.pdf", bytearray(b"new")), ("in/c.pdf", bytearray(b"bad"))], "path string, content binary")
    assert {(r.path, r.action, r.error is None) for r in sw.incremental_compile(worse, root, now, extractor="picky").collect()} == {("in/a b.pdf", "compile", True), ("in/c.pdf", "compile", False)}
    assert sw.cs.get_compile_status(spark, root).first().entries_compiled == 1
    again = sw.incremental_compile(worse, root, now, extractor="picky").collect()
    assert {(r.path, r.action) for r in again} == {("in/a b.pdf", "skip"), ("in/c.pdf", "compile")}
    with pytest.raises(Exception, match="not a path below the root"):
        sw.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), root)


def test_recompiling_an_entry(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.pdf").write_bytes(b"new")
    (tmp_path / "wiki" / "it").mkdir(parents=True)
    page = PAGE.format(t="Go", r="").replace("tags:", "source: raw/s.pdf\nsource_hash: old\ncategory: 'a: b'\naggregated_from: [x]\ntags:")
    (tmp_path / "wiki" / "it" / "c.md").write_text(page)
    got = sw.recompile_file(spark, root, "it/c.md", F.expr("timestamp'2030-01-01 00:00:00'"))
    assert (got["version"], got["source_changed"], got["source_exists"], got["backup"]) == (1, True, True, "wiki/.versions/c_v0.md")
    assert (tmp_path / "wiki" / ".versions" / "c_v0.md").read_text() == page
    (e,) = sf.scan_entries(sf.read_markdown(spark, f"{root}/wiki")).collect()
    assert (e.title, e.version, e.status, e.category, e.source, e.aggregated_from, e.updated.year, e.body.strip()) == ("Go", 1, "needs_recompile", "a: b", "raw/s.pdf", ["x"], 2030, "All about Go.")
    assert e.source_hash != "old"
    with pytest.raises(FileNotFoundError):
        sw.recompile_file(spark, root, "it/none.md", F.current_timestamp())


def test_batches_report_their_progress(spark):
    files = spark.createDataFrame([(f"p{k}", bytearray(b"x" if k else b"")) for k in range(7)], "path string, content binary")
    sf.register_extractor("strict", lambda raw: [raw.decode()] if raw else 1 / 0)
    seen = []
    assert sf.batch_process(files, "strict", lambda *x: seen.append(x), parts=3).where("error is null").count() == 6
    assert len(seen) == 3 and seen[-1] == (7, 1, 7) and [x[0] for x in seen] == sorted(x[0] for x in seen)


def test_pdf_stand_ins(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"page one\x0cpage two ")
    (tmp_path / "y.PDF").write_bytes(b"z")
    assert sf.list_raw_pdfs(spark, str(tmp_path)).count() == 1
    files = sf.scan_pdf(spark, str(tmp_path))
    pages = sf.extract_structured(files)
    assert sorted((r.page_number, r.text) for r in pages.collect()) == [(1, "page one"), (1, "z"), (2, "page two")]
    assert {r.text for r in sf.extract_text(pages).collect()} == {"page one\npage two", "z"}
    sf.register_extractor("broken", lambda raw: 1 / 0)
    assert sf.extract_structured(files, "broken").where("error is not null").count() == 2
    assert sf.dir_size(spark, str(tmp_path)).first()["bytes"] == 19


def test_alert_rules():
    out, _ = ss.alert_rules([(0.0, "m", "hi"), (4.0, "m", "hi"), (6.0, "m", "hi"), (12.0, "n", "hi"), (80.0, "m", "hi")])
    assert [(o[3], o[4]) for o in out] == [("new", 1), ("cooldown", 0), ("merged", 2), ("new", 1), ("new", 1)]
    out, _ = ss.alert_rules([(5.0 * k, f"m{k}", "hi") for k in range(12)])
    assert [o[3] for o in out][-2:] == ["rate_limited", "rate_limited"]


def _run(frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return frame.sparkSession.table(name)


def test_streams_equal_batch(spark, tmp_path):
    schema = "ts timestamp, tool string, latency_ms long, success boolean, channel string, at double, metric string, severity string, value string"
    rows = [(None, f"t{k % 3}", k, k % 4 != 0, f"c{k % 2}", 3.0 * k, "m", "hi", '{"metric":"cpu","data":"1"}' if k % 2 else "junk") for k in range(24)]
    for k in range(2):
        spark.createDataFrame(rows[12 * k : 12 * k + 12], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batch = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    counted = _run(ss.tool_metrics_stream(stream()), "complete", "counted")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, ss.tool_metrics_stream(batch).collect()))
    seen = _run(ss.sse_dispatch(stream()), "append", "seen")
    assert seen.count() == 12
    alerts = _run(ss.alert_stream(stream().select("channel", "at", "metric", "severity")), "append", "alerts")
    assert sorted(map(tuple, alerts.collect())) == sorted(map(tuple, ss.alert_aggregator(batch).collect()))


def test_last_samples_stream(spark, tmp_path):
    schema = "metric string, at double, value double"
    rows = [(f"m{k % 3}", float(k), None if k % 17 == 5 else float(k * 37 % 101)) for k in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = _run(ss.last_samples_stream(stream, 10), "update", "last_samples").collect()
    for name in ("m0", "m1", "m2"):
        values = [v for m, _, v in rows if m == name and v is not None][-10:]
        assert tuple(ss.window_stats(values)) in {tuple(r)[1:] for r in seen if r.metric == name}


def test_windows_and_files_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("metric"), "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = _run(ss.windowed_metrics(stream), "append", "windows")
    assert 0 < out.count() <= ss.windowed_metrics(events).count()
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"x")
    found = _run(ss.incremental_files(spark, str(tmp_path / "pdf")).drop("content"), "append", "found")
    assert found.count() == 1
