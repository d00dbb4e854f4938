"""Stored pages as a registered source, in batch and as a stream.

    pagesource.register(spark)
    spark.read.format("stored_pages").options(path=folder, monitor="json_ld").load()
    spark.readStream.format("stored_pages").options(path=folder, monitor="json_ld").load()

A monitor turns a page into rows; ``MONITORS`` names them with the columns they give beside the
page's key. Options: ``path`` (a Parquet file or a folder of them), ``monitor``, ``key`` and
``html`` (columns; page_id and html), ``key_type`` (bigint), ``marker`` (for embedded_json) and
``split_bytes``.

A partition is a range of bytes of a file, planned from the listing alone; its task reads the
footer and takes the row groups that begin in the range. Two columns are read.

The stream reads folders ``path/batch=N``, as ``streaming.ledger.folder`` writes them, and its
offset is the last N whose writer is done (``_SUCCESS``), so a replayed batch reads the same
files. Numbers must rise with time. Each trigger takes all that is new.

Edge cases: pages without a match give no rows, except that ``pages`` gives every page; null
HTML matches nothing; further columns are not read; a folder without files gives no rows; an
unknown monitor is an error.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from . import readers

NAME = "stored_pages"
SPLIT_BYTES = 128 * 1024 * 1024
#: Pages that a task holds at a time.
PAGES = 500

Found = list[tuple]
_HREF = re.compile(readers.HREF, re.ASCII)


def _links(html: str | None, marker: str) -> Found:
    return [(u,) for u in dict.fromkeys(u.replace("&amp;", "&") for u in _HREF.findall(html or ""))]


def _json_ld(html: str | None, marker: str) -> Found:
    row = readers.posting_of(html)
    return [] if row["title"] is None else [tuple(row[n] for n in readers.POSTING.names)]


def _embedded(html: str | None, marker: str) -> Found:
    payload = readers.balanced_json(html, marker)
    return [] if payload is None else [(payload,)]


class Monitor(NamedTuple):
    """The columns that a monitor gives, all strings, and the rows of one page."""

    columns: Sequence[str]
    rows: Callable[[str | None, str], Found]


MONITORS = {
    "pages": Monitor(["html"], lambda html, marker: [(html,)]),
    "links": Monitor(["link"], _links),
    "json_ld": Monitor(readers.POSTING.names, _json_ld),
    "embedded_json": Monitor(["payload"], _embedded),
}


class Split(InputPartition):
    """Row groups of a file that begin at a byte from ``start`` to before ``end``."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def _begin(group: pq.RowGroupMetaData) -> int:
    column = group.column(0)
    return min(column.data_page_offset, column.dictionary_page_offset or column.data_page_offset)


class _Pages:
    """What the batch and the stream reader share: listing, splits, and rows of a split."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.given, self.options = schema, options
        self.path = options["path"]

    def splits(self, folder: str) -> list[Split]:
        """Splits of the Parquet files under a folder, or of one file; hidden files do not count."""
        fs, top = _store(folder)
        step = int(self.options.get("split_bytes", SPLIT_BYTES))
        info = fs.get_file_info(top)
        files = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True))
        seen = sorted((f.path, f.size) for f in files if f.type == pyarrow.fs.FileType.File and not re.search(r"(^|/)[._][^/]*(/|$)", f.path[len(top) :]))
        return [Split(path, at, at + step) for path, size in seen for at in range(0, size, step)]

    def rows(self, split: Split) -> Iterator[pa.RecordBatch]:
        key, html, marker = (self.options.get(k, default) for k, default in (("key", "page_id"), ("html", "html"), ("marker", "window.state =")))
        take, schema = MONITORS[self.options["monitor"]].rows, to_arrow_schema(self.given)
        with _store(self.path)[0].open_input_file(split.file) as f:
            file = pq.ParquetFile(f)
            groups = [g for g in range(file.num_row_groups) if split.start <= _begin(file.metadata.row_group(g)) < split.end]
            for batch in file.iter_batches(PAGES, groups, [key, html]) if groups else ():
                keys = batch.column(key).cast(schema.field(0).type).to_pylist()
                found = [(k, *row) for k, page in zip(keys, batch.column(html).to_pylist()) for row in take(page, marker)]
                columns = zip(*found) if found else ([] for _ in schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Split]:
        return self.splits(self.path)

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition else iter(())  # without files there is one empty partition


class PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, int]:
        return {"batch": -1}

    def _batches(self) -> list[int]:
        fs, top = _store(self.path)
        names = (f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True)))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"batch=(\d+)", n)))

    def latestOffset(self) -> dict[str, int]:
        fs, top = _store(self.path)
        done = lambda n: fs.get_file_info(posixpath.join(top, f"batch={n}", "_SUCCESS")).type == pyarrow.fs.FileType.File
        return {"batch": next((n for n in reversed(self._batches()) if done(n)), -1)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Split]:
        new = [n for n in self._batches() if start["batch"] < n <= end["batch"]]
        return [s for n in new for s in self.splits(f"{self.path.rstrip('/')}/batch={n}")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict[str, int]) -> None:
        """Folders stay; whoever writes them removes them."""


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        monitor = self.options.get("monitor")
        if monitor not in MONITORS:
            raise ValueError(f"monitor must be one of {sorted(MONITORS)}")
        key = f"`{self.options.get('key', 'page_id')}` {self.options.get('key_type', 'bigint')}"
        return ", ".join([key, *(f"`{c}` string" for c in MONITORS[monitor].columns)])

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> PageStream:
        return PageStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)
