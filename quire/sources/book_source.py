"""EPUB books as a data source: one partition for each text resource of each book.

``register(spark)`` makes ``spark.read.format("quire_epub").load(path)`` known. The driver reads only the
lists of contents of the files; a resource is unpacked and parsed by the task that reads it, so a large book
is neither one row nor one task. Filters on path, resource and href choose partitions before any is read.
"""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quire.sources import epub
from quire.sources.html import decode

NAME = "quire_epub"
SCHEMA = "path string, resource int, href string, seg int, kind string, anchor string, source string"
_ARROW = pa.schema([("path", pa.string()), ("resource", pa.int32()), ("href", pa.string()), ("seg", pa.int32()), ("kind", pa.string()), ("anchor", pa.string()), ("source", pa.string())])
#: Columns whose filters choose partitions.
CHOSEN = ("path", "resource", "href")


@dataclass
class Resource(InputPartition):
    """A text resource of a book: the book's file in its store, and the name that its rows show."""

    file: str
    path: str
    resource: int
    href: str
    is_contents: bool


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before its paths in rows."""
    uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    store, base = pafs.FileSystem.from_uri(uri)
    scheme = uri.partition("://")[0]
    return store, base, "file:" if scheme == "file" else uri[: len(uri) - len(base)]


def _files(store: pafs.FileSystem, base: str) -> list[str]:
    info = store.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(base)
    if info.type == pafs.FileType.File:
        return [base]
    found = store.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and posixpath.splitext(f.path.lower())[1] == ".epub")


class EpubReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a path to load is missing")
        self.root = options["path"]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and membership on the columns in CHOSEN are done here, the rest is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in CHOSEN:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def _is_wanted(self, **values: object) -> bool:
        return all(v in self.wanted[c] for c, v in values.items() if c in self.wanted)

    def partitions(self) -> list[InputPartition]:
        store, base, lead = _store(self.root)
        out: list[InputPartition] = []
        for file in _files(store, base):
            if not self._is_wanted(path=lead + file):
                continue
            with store.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                package, there = epub.read_package(z), set(z.namelist())
            for i, href in enumerate(package.spine):
                if href in there and self._is_wanted(resource=i, href=href):
                    out.append(Resource(file, lead + file, i, href, href in package.contents))
        return out

    def read(self, partition: Resource | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there is nothing to read
            return
        store, _, _ = _store(self.root)
        with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            segments = epub.resource_segments(decode(z.read(partition.href)), partition.resource, partition.is_contents)
        if segments:
            own = {"path": partition.path, "resource": partition.resource, "href": partition.href}
            yield pa.RecordBatch.from_pylist([own | {"seg": k} | {c: s[c] for c in ("kind", "anchor", "source")} for k, s in enumerate(segments)], _ARROW)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpubReader:
        return EpubReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)
