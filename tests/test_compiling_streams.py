"""A stream that compiles exactly once, and alerts whose state empties."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from foliolake.sources import wiki
from foliolake.streaming import alerts, compiling
from foliolake.streaming.streams import alert_rules

NOW = lambda: F.lit("2024-05-01 10:00:00").cast("timestamp")


def _files(folder, names, text="page one\fpage two "):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_text(text + n)


def _run(spark, tmp, **how):
    query = compiling.compile_stream(spark, f"file://{tmp}/in", f"file://{tmp}/kb", f"file://{tmp}/check", now=NOW, domain="IT", **how).trigger(availableNow=True).start()
    query.awaitTermination()


def _state(spark, tmp):
    names = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    state = sorted(map(tuple, wiki.load_state(spark, f"file://{tmp}/kb").select(names("path"), "source_hash", "compiled_entries").collect()))
    seen = sorted(map(tuple, compiling.outcomes(spark, f"file://{tmp}/check").select(names("path"), "action", "error").collect()))
    pages = sorted((p.name, p.read_text()) for p in (tmp / "kb/raw").glob("*.md") if "prompt" not in p.name)
    return [(n, h, list(c)) for n, h, c in state], seen, [(n, t.replace(str(tmp), "")) for n, t in pages]


def test_files_between_triggers_and_cut_off_runs_give_the_rows_of_one(spark, tmp_path, monkeypatch):
    names = [f"a{k}.pdf" for k in range(7)]
    one, many, broken = (tmp_path / x for x in ("one", "many", "broken"))
    for t in (one, many, broken):
        t.mkdir()
    _files(one / "in", names)
    _run(spark, one)
    for k in range(0, 7, 3):  # files added between triggers
        _files(many / "in", names[k : k + 3])
        _run(spark, many, most=2)
    want = _state(spark, one)
    assert len(want[0]) == 7 and {a for _, a, _ in want[1]} == {"compile"}
    assert _state(spark, many) == want
    # Killed between what it wrote and its commit: the second attempt finds the first one's pages and state.
    _files(broken / "in", names)
    real = compiling.write_text
    monkeypatch.setattr(compiling, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed|FOREACH"):
        _run(spark, broken, most=4)
    assert wiki.load_state(spark, f"file://{broken}/kb").count() == 4
    monkeypatch.setattr(compiling, "write_text", real)
    _run(spark, broken, most=4)
    assert _state(spark, broken) == want
    done = {r.batch: (r.scanned, r.compiled, r.skipped) for r in compiling.totals(spark, f"file://{broken}/check").collect()}
    assert done == {0: (4, 4, 0), 1: (3, 3, 0)}


def test_a_batch_that_is_done_is_not_run_again(spark, tmp_path):
    _files(tmp_path / "in", ["x.pdf", "y.pdf"])
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in")
    run = compiling.compile_batch(f"file://{tmp_path}/kb", f"file://{tmp_path}/check/ledger", NOW)
    run(files, 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("kb/**/*") if p.is_file()}
    run(files, 0)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("kb/**/*") if p.is_file()} == before
    run(files, 1)  # the same files in a later batch: nothing is due
    run(files.limit(0), 2)
    assert [tuple(r)[1:] for r in compiling.totals(spark, f"file://{tmp_path}/check").orderBy("batch").collect()] == [(2, 2, 0), (2, 0, 2), (0, 0, 0)]


def test_files_of_one_name_have_pages_of_their_own(spark, tmp_path):
    rows = [("/a/same.pdf", b"first"), ("/b/same.pdf", b"second"), ("/c/other.pdf", b"third")]
    files = spark.createDataFrame(rows, "path string, content binary")
    root = f"file://{tmp_path}"
    assert wiki.incremental_compile(files.where("path <> '/a/same.pdf'"), root, NOW()).where("action = 'compile'").count() == 2
    wiki.incremental_compile(files, root, NOW())
    again = wiki.incremental_compile(files.withColumn("content", F.concat("content", F.lit(b"!"))), root, NOW())
    assert again.where("action = 'compile' and error is null").count() == 3
    pages = {p.name: p.read_text() for p in (tmp_path / "raw").glob("*.md") if "prompt" not in p.name}
    assert len(pages) == 3 and "second!" in pages["same.md"] and "third!" in pages["other.md"]
    assert [t for n, t in pages.items() if n.startswith("same-") and "first!" in t]


def test_alerts_equal_the_rules_on_shuffled_batches(spark, tmp_path):
    r = random.Random(3)
    rows, at = [], {c: 0.0 for c in "ab"}
    for _ in range(120):
        c = r.choice("ab")
        at[c] += r.choice([0.5, 1.5, 3.0, 6.0, 6.5, 40.0])
        rows.append((c, at[c], r.choice(["cpu", "disk"]), r.choice(["warn", "high"])))
    want = sorted((c, *x) for c in "ab" for x in alert_rules(sorted(y[1:] for y in rows if y[0] == c))[0])
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "channel string, ts timestamp, metric string, severity string"

    def put(number, part):
        frame = spark.createDataFrame(part, "channel string, at double, metric string, severity string")
        frame.select("channel", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "metric", "severity").coalesce(1).write.parquet(f"file://{tmp_path}/draft{number}")
        for f in (tmp_path / f"draft{number}").glob("part-*.parquet"):
            shutil.move(str(f), str(folder / f"{number:03d}.parquet"))

    stream = alerts.expiring_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"), late="400 seconds")
    query = stream.writeStream.format("memory").queryName("alerted").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").start()
    try:
        ordered = sorted(rows, key=lambda x: x[1])
        for k in range(0, 120, 40):  # rows of neighbouring batches change places
            ordered[k : k + 40] = r.sample(ordered[k : k + 40], 40)
        for number, k in enumerate(range(0, 120, 30)):
            put(number, ordered[k : k + 30])
            query.processAllAvailable()
        put(8, [("z", 1e6, "cpu", "warn")])
        query.processAllAvailable()
        put(9, [("z", 1e6 + 1, "cpu", "warn")])
        query.processAllAvailable()
        got = sorted(tuple(x) for x in spark.sql("select channel, at, metric, severity, outcome, n from alerted where channel <> 'z'").collect())
        assert got == want and {x[4] for x in got} >= {"new", "merged", "cooldown"}
        put(10, [("y", 2e6, "cpu", "warn")])
        query.processAllAvailable()
        put(11, [("y", 3e6, "cpu", "warn")])
        query.processAllAvailable()
        held = spark.read.format("statestore").option("stateVarName", "alerts").load(f"file://{tmp_path}/check")
        left = spark.read.format("statestore").option("stateVarName", "last").load(f"file://{tmp_path}/check")
        assert {x.key[0] for x in held.collect()} | {x.key[0] for x in left.collect()} <= {"y"}  # all others are long idle
    finally:
        query.stop()


def test_a_folder_in_batches_reads_each_file_once(spark, tmp_path):
    from foliolake.sources import files as sf
    from foliolake.streaming.batches import batch_process_folder

    notes = tmp_path / "notes"
    notes.mkdir()

    def noting(raw, notes=str(notes)):
        import uuid

        with open(f"{notes}/{uuid.uuid4().hex}", "wb") as f:
            f.write(raw)
        return [str(1 // (len(raw) % 5)), "second"]

    sf.register_extractor("noting_batches", noting)
    names = [f"n{'x' * (k % 7)}{k}.pdf" for k in range(11)]
    _files(tmp_path / "in", names, text="page one ")
    reports = []
    run = lambda: batch_process_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check", most=4, extractor="noting_batches", report=lambda *x: reports.append(x))
    pages = run()
    bad = [n for n in names if len("page one " + n) % 5 == 0]
    assert bad and len(list(notes.iterdir())) == 11
    assert [x[0] for x in reports] == [4, 8, 11] and reports[-1] == (11, len(bad), 11)
    assert pages.where("error is null").count() == 2 * (11 - len(bad)) and pages.where("error is not null").count() == len(bad)
    assert run().count() == pages.count() and len(list(notes.iterdir())) == 11
    with pytest.raises(KeyError):
        batch_process_folder(spark, "x", "y", "z", extractor="unknown")
