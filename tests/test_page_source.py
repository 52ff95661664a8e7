"""The page extractors as a data source."""

from __future__ import annotations

import pickle

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliolake.sources import files as sf
from foliolake.sources import wiki as sw
from foliolake.sources.page_source import PageReader, register_page_source


@pytest.fixture()
def folder(spark, tmp_path):
    register_page_source(spark)
    (tmp_path / "sub").mkdir()
    for k in range(12):
        (tmp_path / ("sub" if k % 3 == 0 else ".") / f"f{k}.pdf").write_text("\f".join(f" page {p} of {k} é " for p in range(k % 4 + 1)))
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no pdf")
    return tmp_path


def test_equals_extract_structured(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(f"file://{folder}")
    want = sf.extract_structured(files).select(F.regexp_replace("path", "^file:/*", "/"), "page_number", "text", "error")
    got = spark.read.format("foliolake_pages").option("suffix", ".pdf").option("bytesPerPartition", "60").load(f"file://{folder}")
    full = got.where("length > 0").select("path", "page_number", "text", "error").collect()  # binaryFile leaves empty files out
    assert sorted(map(tuple, full), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.rdd.getNumPartitions() > 3 and got.where("length = 0").count() == 1


def test_options_on_paths_open_those_files_only(spark, folder, tmp_path_factory):
    notes = tmp_path_factory.mktemp("opened")

    def noting(raw, notes=str(notes)):
        import uuid

        with open(f"{notes}/{uuid.uuid4().hex}", "wb") as f:
            f.write(raw)
        return raw.decode().split("\f")

    sf.register_extractor("noting", noting)
    register_page_source(spark, "noting", "noted_pages")
    pages = spark.read.format("noted_pages").option("suffix", ".pdf").load(f"file://{folder}")

    def opened(df, n):
        rows = df.collect()
        files = list(notes.iterdir())
        for f in files:
            f.unlink()
        assert len(files) == n
        return rows

    one, three = str(folder / "f1.pdf"), str(folder / "sub/f3.pdf")
    some = lambda **o: spark.read.format("noted_pages").options(**o).load(f"file://{folder}")
    assert sorted(r.page_number for r in opened(some(files=one), 1)) == [1, 2]
    assert len(opened(some(files=f"{one}\n{three}"), 2)) == 6
    assert len({r.path for r in opened(some(prefix=str(folder / "sub")).where("page_number > 1"), 4)}) == 3
    assert opened(some(files="nothing"), 0) == []
    # A condition rules out rows, not files, and leaves nothing behind in the frame.
    assert len(opened(pages.where(F.col("path") == one), 13)) == 2 and len(opened(pages, 13)) == 31
    # Columns that need no content open nothing.
    listed = spark.read.format("noted_pages").schema("length long, path string").option("suffix", ".pdf").load(f"file://{folder}")
    assert len(opened(listed.where(F.endswith("path", F.lit("1.pdf"))), 0)) == 2 and len(opened(listed, 0)) == 13


def test_a_bad_file_is_reported(spark, folder):
    sf.register_extractor("odd", lambda raw: [str(1 // (len(raw) % 2))])
    register_page_source(spark, "odd", "odd_pages")
    rows = spark.read.format("odd_pages").load(f"file://{folder}").select("text", "error", "length").collect()
    assert {(r.text, r.error) for r in rows if r.length % 2} == {("1", None)}
    assert all("zero" in r.error for r in rows if r.length % 2 == 0)
    with pytest.raises(KeyError):
        register_page_source(spark, "unknown")


def test_planning_hands_on_few_bytes_for_each_file(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4000):
        (tmp_path / "in" / f"{k}.pdf").write_text("x" * (k % 7))
    reader = PageReader(StructType(), {"path": f"file://{tmp_path}", "suffix": ".pdf", "bytesPerPartition": "4000"}, str)
    runs = reader.partitions()
    assert sorted(f for r in runs for f in r.files) == sorted((f"{tmp_path}/in/{k}.pdf", k % 7) for k in range(4000))
    assert max(sum(n for _, n in r.files) for r in runs) <= 4000 and len(pickle.dumps(runs)) < 15 * 4000


@pytest.mark.parametrize("bad", [False, True])
def test_writers_leave_no_drafts(spark, tmp_path, bad):
    rows = spark.createDataFrame([("a/1.pdf", "x"), ("../b" if bad else "b", "y")], "path string, content string").coalesce(1)
    try:
        sw.write_files(rows, f"file://{tmp_path}/in")
        assert not bad
    except Exception as e:
        assert bad and "not a path below the root" in str(e)
    assert [p for p in tmp_path.rglob("*") if p.name.startswith(".")] == []
    assert bad or (tmp_path / "in/a/1.pdf").read_text() + (tmp_path / "in/b").read_text() == "xy"
