"""Folders of Arrow IPC files as a Spark data source, format `arrow_folder`: stream and file format, splits inside a file, chosen columns.

    spark.dataSource.register(ArrowFolder)
    spark.read.format("arrow_folder").option("columns", "a,b").load(path)
    df.write.format("arrow_folder").mode("append").save(path)

Both formats are a sequence of messages, each with a header that says how long its body is; the file format has a mark in front and an
index behind. So a task that owns a range of bytes walks over headers alone up to its range and reads the record batches that start inside, as
readers of lines do. Paths are those of any store that Arrow reaches (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
#: Fixed values of the format: its mark, what opens a message, and the kinds of headers.
MAGIC, CONTINUES = b"ARROW1\0\0", 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
SUFFIX = ".arrow"
#: Bytes of a file that its schema's message is looked for in, where files come whole.
HEAD = 16 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", re.sub(r"^s3[an]:", "s3:", path)) if ":" in path else f"file://{path}")


def files_in(path: str) -> list[tuple[str, int]]:
    """(whole path, bytes) of a file, or of all files of a folder and those below that end in .arrow; hidden ones are none."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((path.rstrip("/") + f.path[len(inner.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and not f.base_name.startswith((".", "_")))


def header_of(meta: bytes) -> tuple[int, int]:
    """(kind, length of the body) from a message's header, a table of the flatbuffers format: a field's place stands in the table's own index."""
    table = struct.unpack_from("<I", meta)[0]
    index = table - struct.unpack_from("<i", meta, table)[0]

    def field(number: int, form: str) -> int:
        size = struct.unpack_from("<H", meta, index)[0]
        at = struct.unpack_from("<H", meta, index + 4 + 2 * number)[0] if 4 + 2 * number < size else 0
        return struct.unpack_from(form, meta, table + at)[0] if at else 0

    return field(1, "<B"), field(3, "<q")


def messages(file, size: int) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of every message of a file, by its headers."""
    at = len(MAGIC) if file.read(len(MAGIC)) == MAGIC else 0
    while at + 8 <= size:
        file.seek(at)
        first, length = struct.unpack("<II", file.read(8))
        head = 8
        if first != CONTINUES:  # as it was before version 0.15
            first, length, head = CONTINUES, first, 4
            file.seek(at + 4)
        if length == 0:
            return
        meta = file.read(length)
        if len(meta) < length:
            raise OSError(f"a message at byte {at} is cut off")
        kind, body = header_of(meta)
        yield kind, at, at + head + length + body
        at += head + length + body


def batches_between(path: str, begin: int, end: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The record batches of a file that start in [begin, end), and of them only some columns."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as file:

        def bytes_of(start: int, stop: int) -> bytes:
            file.seek(start)
            return file.read(stop - start)

        before: list[bytes] = []
        for kind, start, stop in list_until(messages(file, file.size()), end):
            if kind != BATCH:
                before.append(bytes_of(start, stop))
            elif start >= begin:
                whole = pa.BufferReader(b"".join([*before, bytes_of(start, stop)]))
                names = pa.ipc.open_stream(pa.BufferReader(before[0])).schema.names
                chosen = None if columns is None else [names.index(c) for c in columns]
                yield from pa.ipc.open_stream(whole, options=pa.ipc.IpcReadOptions(included_fields=chosen))


def list_until(found: Iterator[tuple[int, int, int]], end: int) -> Iterator[tuple[int, int, int]]:
    for kind, start, stop in found:
        if start >= end:
            return
        yield kind, start, stop


def schema_of(path: str) -> pa.Schema:
    store, inner = store_of(path)
    with store.open_input_file(inner) as file:
        _, start, stop = next(messages(file, file.size()))
        file.seek(start)
        return pa.ipc.open_stream(pa.BufferReader(file.read(stop - start))).schema


@dataclass
class Range(D.InputPartition):
    path: str
    begin: int
    end: int


class ArrowReader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[Range]:
        return [Range(name, at, min(at + self.split, size)) for name, size in files_in(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        target = to_arrow_schema(self.schema)
        for b in batches_between(partition.path, partition.begin, partition.end, names):
            t = pa.Table.from_batches([b]).select(names).cast(target)
            yield from t.to_batches()


@dataclass
class Written(D.WriterCommitMessage):
    name: str | None


class ArrowWriter(D.DataSourceArrowWriter):
    """A file in stream format for every task that has rows, under a hidden name until the whole job commits."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = store_of(self.path)
        store.create_dir(inner)
        name, out = f"{self.run}-{uuid.uuid4().hex}{SUFFIX}", None
        for b in iterator:
            if out is None:
                file = store.open_output_stream(f"{inner}/.{name}")
                out = pa.ipc.new_stream(file, b.schema)
            out.write_batch(b)
        if out is None:
            return Written(None)
        out.close()
        file.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        store.create_dir(inner)
        old = [f for f, _ in files_in(self.path)] if self.overwrite else []
        kept = [m.name for m in messages if m and m.name]
        if not kept:  # an empty table still has a schema
            kept = [f"{self.run}{SUFFIX}"]
            with store.open_output_stream(f"{inner}/.{kept[0]}") as file, pa.ipc.new_stream(file, to_arrow_schema(self.schema)):
                pass
        for name in kept:
            store.move(f"{inner}/.{name}", f"{inner}/{name}")
        for f in old:
            store.delete_file(store_of(f)[1])
        self._sweep(store, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*store_of(self.path))

    def _sweep(self, store: fs.FileSystem, inner: str) -> None:
        """Files of tasks that failed or ran twice."""
        for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}"):
                store.delete_file(f.path)


class ArrowFolder(D.DataSource):
    """Options: path, columns (names by comma; all by default), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def schema(self) -> StructType:
        files = files_in(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no {SUFFIX} file in {self.options['path']}")
        whole = from_arrow_schema(schema_of(files[0][0]))
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in chosen]) if chosen else whole

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def reaches(path: str) -> bool:
    """Whether Arrow opens paths of this scheme by itself."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def whole_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The same rows through Spark's own reader of files, for stores that only Hadoop knows. A task gets a file at a time, whole, so files
    must fit in memory (and 2 GB); the first file's first message tells the schema."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    first = files.orderBy("path").select(F.substring("content", 1, HEAD).alias("head")).first()
    if first is None:
        raise FileNotFoundError(f"no {SUFFIX} file in {path}")
    source = pa.BufferReader(first.head)
    _, start, stop = next(messages(source, len(first.head)))
    whole = from_arrow_schema(pa.ipc.open_stream(pa.BufferReader(first.head[start:stop])).schema)
    schema = StructType([whole[c] for c in columns]) if columns else whole
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data = content.as_buffer()
                stream = pa.BufferReader(data.slice(len(MAGIC)) if data[: len(MAGIC)].to_pybytes() == MAGIC else data)
                names = pa.ipc.open_stream(stream).schema.names
                stream.seek(0)
                for batch in pa.ipc.open_stream(stream, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in target.names])):
                    yield from pa.Table.from_batches([batch]).select(target.names).cast(target).to_batches()

    return files.select("content").mapInArrow(run, schema)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A folder (or file) of Arrow IPC files; only these columns are decoded. All files have the first one's schema. Where Arrow can't open the
    path, Spark reads whole files instead."""
    if not reaches(path):
        return whole_files(spark, path, columns)
    spark.dataSource.register(ArrowFolder)
    reader = spark.read.format("arrow_folder").option("splitBytes", split_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ArrowFolder)
    df.write.format("arrow_folder").mode(mode).save(path)
