"""Documents as files: a data source that reads texts out of a folder, and writes documents into one.

``spark.read.format("documents").load(folder)`` gives path, suffix, length and text of all files below a folder. Filters on suffix and
length are pushed down, so other files are never opened; partitions hold files of bounded bytes. The listing is the driver's, as for Spark's
own file sources.

``df.write.format("documents").mode("append").save(folder)`` writes rows (name, text), one file each, as its name's suffix says. A task
writes into a folder of its own under a staging folder; the commit moves whole task folders into place, so a failed task or job leaves
nothing, and a repeated task nothing twice. Option ``skeleton`` names a .docx whose styles, headers and footers the written ones get.

Options: ``partitionBytes`` (64 MB). Register once a session: ``register(spark)``.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

from .pdf import read_pdf
from .word import fill_docx, read_docx, write_docx

SCHEMA = "path string, suffix string, length long, text string"
#: Readers by suffix; others give a blank text.
READERS = {"docx": read_docx, "pdf": read_pdf, "txt": lambda b: b.decode("utf-8", "replace")}
_BATCH = 8 << 20
#: Characters that no package can hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def suffix_of(path: str) -> str:
    return posixpath.splitext(path)[1][1:].lower()


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.limit = options["path"], int(options.get("partitionbytes", 64 << 20))
        self.suffixes: frozenset[str] | None = None
        self.least, self.most = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what bounds suffix and length; yields the rest, which Spark applies itself."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("suffix",) and isinstance(f, (EqualTo, In)):
                these = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.suffixes = these if self.suffixes is None else self.suffixes & these
            elif name == ("length",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and name in (("suffix",), ("length",), ("path",))):
                yield f

    def wanted(self, path: str, size: int) -> bool:
        return self.least <= size <= self.most and (self.suffixes is None or suffix_of(path) in self.suffixes)

    def partitions(self) -> list[Files]:
        """Files in order of path, in partitions of at most ``limit`` bytes (or of one file)."""
        store, root = _opened(self.uri)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
        files = sorted((i.path, i.size) for i in found if i.is_file and not hidden(i.path) and self.wanted(i.path, i.size))
        out: list[Files] = []
        room = -1
        for path, size in files:
            if room < size:
                out.append(Files([]))
                room = self.limit
            out[-1].files.append((path, size))
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.uri)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.files:
            kind = suffix_of(path)
            read = READERS.get(kind)
            text = ""
            if read:
                with store.open_input_stream(path) as f:
                    text = read(f.read())
            rows.append((path, kind, size, text and text.strip()))
            held += size
            if held >= _BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "suffix", "length", "text"])


@dataclass
class Part(WriterCommitMessage):
    folder: str
    n: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.job = f"_staged-{uuid.uuid4().hex}"
        self.skeleton = None
        if "skeleton" in options:
            store, path = _opened(options["skeleton"])
            with store.open_input_stream(path) as f:
                self.skeleton = f.read()

    def render(self, name: str, text: str) -> bytes:
        if suffix_of(name) != "docx":
            return text.encode()
        lines = [x.strip() for x in _UNFIT.sub("", text).split("\n") if x.strip()]
        return fill_docx(self.skeleton, lines) if self.skeleton else write_docx(lines)

    def write(self, iterator: Iterator) -> Part:
        store, root = _opened(self.uri)
        folder, n = f"part-{uuid.uuid4().hex}", 0
        store.create_dir(f"{root}/{self.job}/{folder}", recursive=True)
        for r in iterator:
            if "/" in r.name or r.name in ("", ".", ".."):
                raise ValueError(f"not a file's name: {r.name!r}")
            with store.open_output_stream(f"{root}/{self.job}/{folder}/{r.name}", compression=None) as f:
                f.write(self.render(r.name, r.text or ""))
            n += 1
        return Part(folder, n)

    def _clear(self) -> None:
        store, root = _opened(self.uri)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _opened(self.uri)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.job:
                    (store.delete_file if old.is_file else store.delete_dir)(old.path)
        for m in messages:
            if m is not None and m.n:
                store.move(f"{root}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"name", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"documents are rows of name and text; {', '.join(sorted(missing))} is missing")
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
