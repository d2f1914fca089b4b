"""Corpora as they are published: archives that tasks read where they lie, on any file system that pyarrow knows, and their download."""

from __future__ import annotations

import fnmatch
import gzip
import tarfile
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a piece of a download, of text that is cut into lines at once, and of members that a task reads.
CHUNK, TEXT, TASK = 1 << 16, 4 << 20, 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def download(url: str, path: str, progress: Callable[[int, int], None] | None = None) -> str:
    """url's content at path, by pieces of CHUNK bytes; progress gets the bytes so far and all bytes (0: unknown).  A download that was
    cut leaves nothing at path."""
    system, to = opened(path)
    system.create_dir(to.rpartition("/")[0] or ".", recursive=True)
    with urllib.request.urlopen(url) as got:
        total, so_far = int(got.headers.get("Content-Length") or 0), 0
        with system.open_output_stream(f"{to}.part", compression=None) as out:
            while piece := got.read(CHUNK):
                out.write(piece)
                so_far += len(piece)
                if progress:
                    progress(so_far, total)
    system.move(f"{to}.part", to)
    return path


def kind_of(path: str) -> str:
    for kind, ends in (("zip", (".zip",)), ("gzipped tar", (".tar.gz", ".tgz")), ("tar", (".tar",))):
        if path.lower().endswith(ends):
            return kind
    raise ValueError(f"{path}: neither a zip nor a tar nor a gzipped tar")


@dataclass
class Members(InputPartition):
    """Some members of an archive, by name and, in a tar, place; none: all of them, one after the other."""

    path: str
    names: tuple[tuple[str, int, int], ...] | None


class ArchiveLines(DataSource):
    """(file, line_no from 0, value) of the text members of an archive, whose names match a pattern; a member's file is path!name.

    Options: path, and members, such as *.xml (all).  A zip's and a plain tar's members are dealt over tasks; a gzipped tar can only be
    read from its start, so it is one task, which holds a piece of a member at a time.  Members that are gzipped themselves are inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "file string, line_no bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("members", "*"))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def _wanted(self, name: str) -> bool:
        return fnmatch.fnmatchcase(name, self.pattern)

    def partitions(self) -> list[Members]:
        if kind_of(self.path) == "gzipped tar":
            return [Members(self.path, None)]
        system, at = opened(self.path)
        with system.open_input_file(at) as f:
            if kind_of(self.path) == "zip":
                found = [(x.filename, 0, x.file_size) for x in zipfile.ZipFile(f).infolist() if not x.is_dir()]
            else:
                with tarfile.open(fileobj=f) as t:
                    found = [(x.name, x.offset_data, x.size) for x in t if x.isfile()]
        parts: list[list] = []
        size = TASK
        for x in found:
            if self._wanted(x[0]):
                if size >= TASK:
                    parts.append([])
                    size = 0
                parts[-1].append(x)
                size += x[2]
        return [Members(self.path, tuple(p)) for p in parts]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, at = opened(partition.path)
        if partition.names is None:
            with system.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as t:
                for x in t:
                    if x.isfile() and self._wanted(x.name):
                        yield from self._lines(x.name, t.extractfile(x))
            return
        with system.open_input_file(at) as f:
            packed = zipfile.ZipFile(f) if kind_of(partition.path) == "zip" else None
            for name, start, size in partition.names:
                if packed:
                    with packed.open(name) as m:
                        yield from self._lines(name, m)
                else:
                    f.seek(start)
                    yield from self._lines(name, _Part(f, size))

    def _lines(self, name: str, stream) -> Iterator[pa.RecordBatch]:
        if name.endswith(".gz"):
            stream = gzip.GzipFile(fileobj=stream)
        rest, n = b"", 0
        while True:
            piece = stream.read(TEXT)
            lines = (rest + piece).split(b"\n")
            rest = lines.pop() if piece else b""
            if not piece and lines and not lines[-1]:
                lines.pop()  # nothing follows the last line's end
            if lines:
                texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([f"{self.path}!{name}"] * len(texts)), pa.array(range(n, n + len(texts)), pa.int64()), pa.array(texts)], names=["file", "line_no", "value"])
                n += len(texts)
            if not piece:
                return


class _Part:
    """The next size bytes of a stream."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def read(self, n: int = -1) -> bytes:
        got = self.stream.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(got)
        return got


def archive_lines(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    """(file, line_no, value) of an archive's members, read where it lies; see :class:`ArchiveLines`."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("members", members).load(path)
