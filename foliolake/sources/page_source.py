"""Page extractors as a data source: spark.read.format("foliolake_pages").load(folder) has a row for each page.

A partition is a run of files of bounded size.  The options prefix, suffix and files (paths, one a line) say which files are
opened.  They are options, not conditions pushed down: in PySpark 4.1 a condition that was pushed into a Python source
stays with the loaded frame, so that another query of the same frame without it silently loses rows.  A schema given to the reader says which columns are wanted; without `text`,
`page_number` and `error` no file is opened at all.
"""

from __future__ import annotations

import os
import pickle
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import EXTRACTORS

_SCHEMA = "path string, length long, page_number int, text string, error string"
#: Bytes of files to a partition, and rows handed on together.
RUN, ROWS = 32 << 20, 256


class FileRun(InputPartition):
    """Files with their lengths, packed: all runs pass through the driver, some bytes for each file."""

    def __init__(self, files: list[tuple[str, int]]):
        self.packed = zlib.compress(pickle.dumps(files))

    @property
    def files(self) -> list[tuple[str, int]]:
        return pickle.loads(zlib.decompress(self.packed))


class PageReader(DataSourceReader):
    """Lists the files below `path`, and reads those that the options leave."""

    def __init__(self, schema: StructType, options: dict[str, str], pages_of: Callable[[bytes], list[str]]):
        self.schema, self.pages_of, self.root = schema, pages_of, options["path"]
        self.suffix, self.most = options.get("suffix", ""), int(options.get("bytesPerPartition", RUN))
        self.prefix, self.files = options.get("prefix", ""), set(filter(None, options.get("files", "").split("\n")))

    def _wanted(self, path: str) -> bool:
        return path.startswith(self.prefix) and path.endswith(self.suffix) and (not self.files or path in self.files)

    def _found(self) -> Iterator[tuple[str, int]]:
        """(path, length) of files below the root; those of a local one as they are met, never all at once."""
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(self.root)
        if not isinstance(system, pafs.LocalFileSystem):
            found = system.get_file_info(pafs.FileSelector(base, recursive=True))
            yield from ((x.path, x.size or 0) for x in found if x.type != pafs.FileType.Directory)
            return
        folders = [base]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir():
                        folders.append(e.path)
                    elif not e.is_symlink() or os.path.exists(e.path):
                        yield e.path, e.stat().st_size

    def partitions(self) -> list[InputPartition]:
        runs: list[InputPartition] = []
        held, size = [], 0
        for file in (x for x in self._found() if self._wanted(x[0]) and not x[0].rsplit("/", 1)[-1].startswith((".", "_"))):
            if held and size + file[1] > self.most:
                runs.append(FileRun(held))
                held, size = [], 0
            held.append(file)
            size += file[1]
        return [*runs, FileRun(held)] if held else runs or [FileRun([])]

    def _rows(self, files: list[tuple[str, int]]) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        system, _ = pafs.FileSystem.from_uri(self.root)
        opens = {"text", "page_number", "error"} & set(self.schema.names)
        for path, length in files:
            if not opens:
                yield path, length, None, None, None
                continue
            with system.open_input_file(path) as file:
                raw = file.read()
            try:
                pages = self.pages_of(raw)
            except Exception as e:  # one bad file must not end the job: it is reported
                yield path, length, 0, None, str(e)
                continue
            for k, text in enumerate(pages, 1):
                yield path, length, k, text.strip(), None

    def read(self, partition: FileRun) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        unknown = set(self.schema.names) - set(names)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)} in pages")
        at, kinds = [names.index(n) for n in self.schema.names], to_arrow_schema(self.schema)
        held: list[tuple] = []
        for row in self._rows(partition.files):
            held.append(tuple(row[k] for k in at))
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)


def register_page_source(spark: SparkSession, extractor: str = "text", name: str = "foliolake_pages") -> None:
    """Makes an extractor readable by name: options path (or load's argument), prefix, suffix, files and bytesPerPartition."""
    pages_of = EXTRACTORS[extractor]

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _SCHEMA

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(schema, self.options, pages_of)

    spark.dataSource.register(Pages)
