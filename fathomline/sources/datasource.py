"""Archives as a data source of Spark's own kind: spark.read.format("help_archive"), and df.write.format("help_archive").

Reading. Files below a folder are listed once; an archive's bytes are cut into ranges, and a task reads the zip entries that begin in its ranges, so
a large archive goes through many tasks and small ones share one. Conditions on version and archive drop files before they are opened,
conditions on a page's path drop entries before they are unpacked. Paths are what pyarrow's file systems reach (local and shared folders, S3,
GCS, HDFS); `archive.read_pages` reads through Spark's own file reader instead, one task a file.

Writing. A task makes an archive of the rows that have its name, under a name of its own; all are moved into place when all tasks are done.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from fathomline.functions.versions import normalize

from . import archive as A

NAME = "help_archive"
PAGES = "archive string, version string, path string, html string, size long"
TOC = f"{A.TOC}, version string"
RANGE_BYTES = 8 << 20
#: Files below 16 bytes aren't archives.
LEAST = 16
GLOB = "*_ru.hbk,*_ru.res"
ROWS_A_BATCH = 256


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HelpArchive)


def version_of(path: str) -> str | None:
    """The version that a folder of the path is named by; the last one, if several are."""
    for folder in reversed(path.split("/")[:-1]):
        if re.fullmatch(r"\d+[._]\d+[._]\d+.*", folder):
            return normalize(folder)
    return None


class _Window(io.RawIOBase):
    """A stretch of a file as a file."""

    def __init__(self, f, start: int, size: int):
        self.f, self.start, self.size, self.at = f, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        if n <= 0:
            return b""
        self.f.seek(self.start + self.at)
        got = self.f.read(n)
        self.at += len(got)
        return got


@dataclass
class Ranges(InputPartition):
    """(file, size, first byte, byte behind the last) of archives."""

    parts: list[tuple[str, int, int, int]]


class HelpArchive(DataSource):
    """Options: path; glob, several with commas; what, pages or contents; encodings, in order; onlyHelp, whether other pages are left out; rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TOC if self.options.get("what", "pages") == "contents" else PAGES

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"archive", "path", "html"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"an archive's rows have archive, path and html; {', '.join(sorted(missing))} is missing")
        return ArchiveWriter(self.options["path"], overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", GLOB).split(",")
        self.what, self.order = options.get("what", "pages"), tuple(options.get("encodings", "utf-8,cp1251").split(","))
        self.only_help = options.get("onlyHelp", "true").lower() == "true"
        self.range_bytes = max(1, int(options.get("rangeBytes", RANGE_BYTES)))
        self.of_file: list[tuple[str, str, object]] = []
        self.of_entry: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on version and archive are for files, those on path for entries; others stay with Spark."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "there"}
        for f in filters:
            kind, column = kinds.get(type(f)), getattr(f, "attribute", (None,))
            if kind and column in (("version",), ("archive",)):
                self.of_file.append((column[0], kind, getattr(f, "value", None)))
            elif kind and column == ("path",) and self.what == "pages":
                self.of_entry.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def _meets(self, rules, **values: str | None) -> bool:
        tests = {"is": lambda v, x: v == x, "in": lambda v, x: v in x, "starts": lambda v, x: v.startswith(x), "ends": lambda v, x: v.endswith(x), "has": lambda v, x: x in v, "there": lambda v, x: True}
        return all(values[c] is not None and tests[kind](values[c], x) for c, kind, x in rules)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.is_file and f.size >= LEAST and any(fnmatch.fnmatch(f.base_name, g) for g in self.glob)]
        files = sorted((p, n) for p, n in files if self._meets(self.of_file, version=version_of(p), archive=p))
        step = self.range_bytes
        ranges = [(p, n, i, min(i + step, n)) for p, n in files for i in (range(0, n, step) if self.what == "pages" else [0])]
        out, own, held = [], [], 0
        for r in ranges:
            if own and held + r[3] - r[2] > step:
                out.append(Ranges(own))
                own, held = [], 0
            own.append(r)
            held += r[3] - r[2]
        return [*out, Ranges(own)] if own else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows = (row for part in partition.parts for row in (self._contents(store, *part) if self.what == "contents" else self._pages(store, *part)))
        schema = pa.schema([("archive", pa.string()), ("version", pa.string()), ("path", pa.string()), ("html", pa.string()), ("size", pa.int64())])
        if self.what == "contents":
            ints = pa.int64()
            schema = pa.schema([("archive", pa.string()), ("id", ints), ("parent_id", ints), ("child_count", ints), ("child_ids", pa.list_(ints)), ("version", pa.string())])
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == ROWS_A_BATCH:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    def _pages(self, store, path: str, size: int, start: int, end: int) -> Iterator[tuple]:
        """Pages of the entries that begin in the range; a file that can't be read as an archive, or from some entry on, gives what it has."""
        version = version_of(path)
        try:
            with store.open_input_file(path) as f:
                at, length = A.places(lambda i, n: _at(f, i, n), size)["FileStorage"]
                with zipfile.ZipFile(_Window(f, at, length)) as z:
                    for entry in z.infolist():
                        if start <= at + entry.header_offset < end and self._meets(self.of_entry, path=entry.filename):
                            html = A.decoded(z.read(entry), self.order)
                            if not self.only_help or A._is_page(entry.filename, html):
                                yield path, version, entry.filename, html, entry.file_size
        except (KeyError, zipfile.BadZipFile, ValueError, EOFError):
            return

    def _contents(self, store, path: str, size: int, start: int, end: int) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            try:
                for row in A.toc(f.read(), self.order):
                    yield path, *row, version_of(path)
            except (zipfile.BadZipFile, ValueError):
                return


def _at(f, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One archive after the other, in memory; its rows (archive, path, html) stand together, as repartition and sortWithinPartitions by archive put them.
        A task that fails takes its own files away."""
        store, root = pafs.FileSystem.from_uri(self.path)
        done: dict[str, str] = {}
        try:
            for name, body in self._bodies(iterator):
                final = f"{root}/{name}"
                if final in done:
                    raise ValueError(f"the rows of {name} don't stand together: sort by archive")
                folder = final.rsplit("/", 1)[0]
                done[final] = f"{folder}/.{uuid.uuid4().hex}.part"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(done[final]) as out:
                    out.write(A.container({"FileStorage": body}))
        except BaseException:
            self._removed(store, done.values())
            raise
        return Written([(kept, final) for final, kept in done.items()])

    def _bodies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        rows = (r for b in batches for r in zip(*b.select(["archive", "path", "html"]).to_pydict().values(), strict=True))
        for name, own in itertools.groupby(rows, key=lambda r: r[0]):
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                for _, path, html in own:
                    if name is None or path is None:
                        raise ValueError("a page to write has no archive or path")
                    z.writestr(zipfile.ZipInfo(path), (html or "").encode(), zipfile.ZIP_DEFLATED)
            yield name, body.getvalue()

    def _removed(self, store, files) -> None:
        for f in files:
            if store.get_file_info(f).type != pafs.FileType.NotFound:
                store.delete_file(f)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m for f in m.files]
        twice = [final for final, n in Counter(final for _, final in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several tasks wrote {min(twice)}: repartition by archive")
        if self.overwrite:
            mine = {kept for kept, _ in files}
            for f in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
                if f.is_file and f.path not in mine:
                    store.delete_file(f.path)
        for kept, final in files:
            store.move(kept, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.path)
        self._removed(store, [kept for m in messages if m for kept, _ in m.files])
