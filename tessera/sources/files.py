"""Image files as a data source of Python: a folder as a table, and a table as a folder of files.

spark.dataSource.register(ImageFiles)
table.select("name", "data").write.format("image_files").mode("append").save(folder)
spark.read.format("image_files").load(folder)

Paths go through pyarrow's file systems, so that any store it knows can be read and written: a folder that all machines
share, or a store by its scheme. Files are written to a hidden folder and moved when all tasks have ended, so that readers
see none of them before; a task that fails, and a name that is there already, leave nothing that a reader sees. Tasks
that are stopped because another failed may leave hidden files, which readers pass over.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Endings of files that are pictures here.
ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".bmp")
#: Bytes of the files of a partition, and of a batch of rows, about.
PARTITION, BATCH = 64 << 20, 8 << 20
SCHEMA = "name string, length long, data binary"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


class ImageReader(DataSourceReader):
    """Files below a folder, by size to partitions; names are relative to it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        store, folder = _place(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        files = [(posixpath.relpath(f.path, folder), f.size) for f in found if f.type == fs.FileType.File]
        files = sorted(f for f in files if f[0].lower().endswith(ENDINGS) and not any(p.startswith((".", "_")) for p in f[0].split("/")))
        parts, held = [[]], 0
        for name, size in files:
            if held + size > PARTITION and parts[-1]:
                parts.append([])
                held = 0
            parts[-1].append((name, size))
            held += size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, folder = _place(self.path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            names, lengths, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())], ["name", "length", "data"])

        for name, size in partition.names:
            with store.open_input_stream(posixpath.join(folder, name)) as f:
                rows.append((name, size, f.read()))
            held += size
            if held >= BATCH:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ImageWriter(DataSourceWriter):
    """Rows (name, data) as files. A name is one file's: two rows of one name, and in "append" mode a name that is there
    already, are errors, and then nothing is written."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        if [f.name for f in schema.fields] != ["name", "data"] or [f.dataType.simpleString() for f in schema.fields] != ["string", "binary"]:
            raise ValueError("image files are written from rows of name (string) and data (binary)")
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = _place(self.path)
        own, names = posixpath.join(folder, self.staging, uuid.uuid4().hex), []
        try:
            self._put(store, own, rows, names)
        except BaseException:
            if store.get_file_info(own).type == fs.FileType.Directory:
                store.delete_dir(own)
            raise
        return Written([posixpath.join(posixpath.basename(own), n) for n in names])

    def _put(self, store: fs.FileSystem, own: str, rows: Iterator[Row], names: list[str]) -> None:
        for row in rows:
            if not row["name"] or row["data"] is None or any(p in ("", ".", "..") or p.startswith("_staging-") for p in row["name"].split("/")):
                raise ValueError(f"no file can be written: name {row['name']!r}, {'no data' if row['data'] is None else 'data'}")
            target = posixpath.join(own, row["name"])
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target) as f:
                f.write(bytes(row["data"]))
            names.append(row["name"])

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        staged = [n for m in messages if m is not None for n in m.names]
        final = [n.split("/", 1)[1] for n in staged]
        try:
            name, times = max(Counter(final).items(), key=lambda x: x[1], default=("", 0))
            if times > 1:
                raise ValueError(f"several rows have one name: {name}")
            if not self.overwrite:
                there = [f.path for f in store.get_file_info([posixpath.join(folder, n) for n in final]) if f.type != fs.FileType.NotFound] if final else []
                if there:
                    raise FileExistsError(there[0])
            for source, name in zip(staged, final, strict=True):
                target = posixpath.join(folder, name)
                store.create_dir(posixpath.dirname(target), recursive=True)
                store.move(posixpath.join(folder, self.staging, source), target)
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = _place(self.path)
        if store.get_file_info(posixpath.join(folder, self.staging)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(folder, self.staging))


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], schema, overwrite)
