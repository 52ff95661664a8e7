"""Files in large numbers: what a task holds, how many tasks there are, how often a file is opened."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from foliolake.functions import files as ff
from foliolake.sources import files as sf
from foliolake.sources import tables
from foliolake.sources import wiki as sw
from foliolake.streaming import batches as sb
from foliolake.streaming import compiling as cst

NOW = lambda: F.expr("timestamp'2030-01-01 00:00:00'")


def test_files_from_one_task_are_written_by_many(spark, tmp_path):
    rows = spark.range(200).coalesce(1).selectExpr("concat('a/', id, '.md') as path", "cast(id as string) as content")
    written = sw.write_files(rows, f"file://{tmp_path}")
    assert len(written.inputFiles()) > 4 and written.agg(F.sum("bytes")).first()[0] == 490
    read = {r["path"]: r["content"] for r in sf.read_markdown(spark, f"file://{tmp_path}").collect()}
    assert read == {f"a/{k}.md": str(k) for k in range(200)}


def test_names_that_urls_escape_are_read_as_they_are(spark, tmp_path):
    names = ["a b.md", "a+b.md", "a%20b.md", "\u00e9#1.md"]
    sw.write_files(spark.createDataFrame([(n, n) for n in names], "path string, content string"), f"file://{tmp_path}")
    assert sorted(tuple(r) for r in sf.read_markdown(spark, f"file://{tmp_path}").collect()) == sorted((n, n) for n in names)


def test_front_matter_is_parsed_once_and_without_the_body(spark):
    head = "---\ntitle: t\ndomain: d\ncreated: 2024-01-01\nupdated: 2024-01-02\n---\n"
    texts = [head + "body", "  \n" + head + "x --- y", "----\n" + head[4:] + "z", "---", "------", "--- title: t", "no", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "path string, content string")
    entries = sf.scan_entries(rows)
    assert entries._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    whole = [k for k, t in enumerate(texts) if ff._fields(t).get("title")]
    found = [int(r["path"]) for r in rows.select("path", ff.parse_front_matter(F.col("content")).alias("e")).where("e.title is not null").collect()]
    assert whole == [0, 1] and sorted(found) == whole


def test_pages_are_handed_on_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([b"x\f" * 10_000, b"y" * (9 << 20), None], pa.binary())], names=["path", "content"])
    out = list(sf._pages(sf.EXTRACTORS["text"])(iter([batch])))
    assert max(b.num_rows for b in out) <= sf.PAGES_HELD and sum(b.num_rows for b in out) == 10_003
    assert out[-1].column(3).to_pylist()[-1] is not None
    assert [n for b in out for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p == "a"] == list(range(1, 10_002))


def test_a_folder_takes_no_more_than_so_many_batches(spark, tmp_path):
    folder, reports = tmp_path / "in", []
    folder.mkdir()
    for k in range(11):
        (folder / f"{k}.pdf").write_text(f"one {k}\ftwo")
    at = lambda name: f"file://{tmp_path}/{name}"
    pages = sb.batch_process_folder(spark, at("in"), at("out"), at("check"), most=1, report=lambda *x: reports.append(x), rounds=4)
    assert [r[0] for r in reports] == [3, 6, 9, 11] and pages.count() == 22


def test_a_batch_opens_each_file_once(spark, tmp_path):
    opened = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def read(path):
        opened.add(1)
        return bytes(path, "utf-8")

    batch = spark.createDataFrame([(f"in/{k}.pdf",) for k in range(5)], "path string").select("path", read("path").alias("content"))
    cst.compile_batch(f"file://{tmp_path}/kb", f"file://{tmp_path}/ledger", now=NOW)(batch, 0)
    assert opened.value == 5
    assert spark.read.parquet(f"file://{tmp_path}/ledger/outcomes").where("action = 'compile' and error is null").count() == 5


def test_as_many_tasks_read_few_files_as_many(spark, tmp_path):
    root = f"file://{tmp_path}"
    sw.write_files(spark.range(1500).selectExpr("concat('a/', id % 2, '/', id, '.md') as path", "cast(id as string) as content"), root)
    pages = sf.read_markdown(spark, root)
    assert pages.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r["path"]: r["content"] for r in pages.collect()} == {f"a/{k % 2}/{k}.md": str(k) for k in range(1500)}


def test_markdown_is_listed_without_what_is_hidden(spark, tmp_path):
    for name in ("a.md", "index.md", "x/log.md", "x/y/b c%.md", "x/empty.md", ".versions/v.md", "_index/s.md", "x/_draft.md", "x/.b.md", "k=1/_p=1.md", "x/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    (tmp_path / "gone.md").symlink_to(tmp_path / "nothing")
    seen = ["a.md", "k=1/_p=1.md", "x/empty.md", "x/y/b c%.md"]
    for root in (f"file://{tmp_path}", f"{tmp_path}/"):
        assert sorted(tuple(r) for r in sf.read_markdown(spark, root).collect()) == [(n, "" if "empty" in n else n) for n in seen]
    some = sf.read_markdown(spark, str(tmp_path), F.startswith("path", F.lit("x/")))
    (tmp_path / "a.md").unlink()  # what is not wanted is not opened
    assert sorted(r["path"] for r in some.collect()) == seen[2:]


def test_a_batch_is_looked_up_and_read_by_few_tasks(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for k in range(300):
        (folder / f"{k}.pdf").write_text(f"one {k}")
    at = lambda name: f"file://{tmp_path}/{name}"
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    pages = sb.batch_process_folder(spark, at("in"), at("out"), at("check"), most=300, report=lambda *x: seen.append(spark.conf.get(key)))
    cores = spark.sparkContext.defaultParallelism
    assert seen == [str(cores)] and spark.conf.get(key) == before
    assert pages.count() == 300 and len(pages.inputFiles()) <= cores


def test_files_of_a_stream_are_looked_up_by_few_tasks_until_it_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(150):
        (tmp_path / "in" / f"{k}.pdf").write_text(f"one {k}\ftwo")
    at = lambda name: f"file://{tmp_path}/{name}"
    key, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before = spark.conf.get(key)

    def now():
        seen.append(spark.conf.get(key))
        return NOW()

    cst.compile_available(spark, at("in"), at("kb"), at("check"), most=100, now=now)
    assert set(seen) == {str(spark.sparkContext.defaultParallelism)} and spark.conf.get(key) == before
    assert cst.outcomes(spark, at("check")).where("error is null").count() == 150
    assert sorted((r["scanned"], r["compiled"]) for r in cst.totals(spark, at("check")).collect()) == [(50, 50), (100, 100)]


def test_compiled_texts_do_not_stay_staged(spark, tmp_path):
    fs, folder = tables.file_system(spark, f"{tables.shared_dir(spark)}/foliolake")
    staged = lambda: {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()
    before = staged()
    rows = [(f"in/{k}.pdf", b" a \f b\n %d" % k) for k in range(20)] + [("in/bad.pdf", None), ("else/1.pdf", b"x")]
    files = spark.createDataFrame(rows, "path string, content binary")
    runs = [{r["path"]: (r["action"], r["error"] is None) for r in sw.incremental_compile(f, f"file://{tmp_path}/kb", NOW()).collect()} for f in (files, files)]
    assert runs[0] == {p: ("compile", c is not None) for p, c in rows}
    assert runs[1] == {p: ("compile", False) if c is None else ("skip", True) for p, c in rows}
    assert {n.split("-")[0] for n in staged() - before} <= {"plan", "outcome", "listed"}
    assert "a\nb" in (tmp_path / "kb/raw/7.md").read_text() and "a\nb" in (tmp_path / "kb/raw/7.compile_prompt.md").read_text()
    assert len(list((tmp_path / "kb/raw").glob("1-*.md"))) + len(list((tmp_path / "kb/raw").glob("1.md"))) == 3
