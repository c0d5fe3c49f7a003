"""A Spark data source and sink of image files, for `spark.read.format("imagefiles")` and `df.write.format("imagefiles")`.

The schema that a reader asks for decides what is fetched: without `content` a file is touched by ranges
only, its first 4 or 16 KiB and, for a JPEG file that says its size further on, the marks on the way there. Filters on path and
length are answered from the listing, before any file is opened. Files are reached through pyarrow's file systems
(local paths and the schemes that it knows); other stores are read whole by `files.read_files`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from . import codecs

FORMAT = "imagefiles"
#: Bytes of a file's head: enough to tell its format, and to find its size in most files.
SNIFF, HEAD = 4_096, 16_384
#: Bytes of files that one task reads, files at most, and bytes that it hands over at once.
TASK_BYTES, TASK_FILES, HELD_BYTES = 1 << 26, 4_096, 1 << 24
KINDS = {"path": pa.string(), "length": pa.int64(), "head": pa.binary(), "frame": pa.binary(), "content": pa.binary(), "bytes_read": pa.int64()}
SCHEMA = "path string, length long, head binary, frame binary, content binary, bytes_read long"


def jpeg_frame(read: Callable[[int, int], bytes], length: int) -> bytes | None:
    """The eight bytes of a JPEG file's frame segment behind its mark (length, precision, height, width, components), by a walk from mark
    to mark however many there are; `read(at, n)` fetches bytes. None without a frame. Marks C4, C8 and CC are none."""
    at = 2
    while at + 4 <= length:
        mark = read(at, 4)
        if len(mark) < 4 or mark[0] != 0xFF:
            return None
        if mark[1] == 0xFF:  # fill
            at += 1
        elif mark[1] == 0x01 or 0xD0 <= mark[1] <= 0xD8:  # marks without a segment
            at += 2
        elif 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            found = read(at + 2, 8)
            return found if len(found) == 8 else None
        elif mark[1] in (0xD9, 0xDA):
            return None
        else:
            at += 2 + int.from_bytes(mark[2:4], "big")
    return None


class Ranges:
    """Bytes of an open file, fetched a page at a time; the head is kept."""

    def __init__(self, file, length: int, head: int):
        self.file, self.length = file, length
        self.head = file.read_at(min(head, length), 0)
        self.page, self.start, self.bytes_read = b"", 0, len(self.head)

    def read(self, at: int, n: int) -> bytes:
        if at + n <= len(self.head):
            return self.head[at : at + n]
        if not (self.start <= at and at + n <= self.start + len(self.page)):
            self.page, self.start = self.file.read_at(min(SNIFF, max(0, self.length - at)), at), at
            self.bytes_read += len(self.page)
        return self.page[at - self.start : at - self.start + n]


def _system(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """(file system, path inside it, what stands before that path in names)."""
    if ":" not in path.split("/")[0]:
        return arrow_fs.LocalFileSystem(), path, ""
    system, inside = arrow_fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


class Group(ds.InputPartition):
    """Files that one task reads: (name, length)."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


_PATH_TESTS = {
    ds.EqualTo: lambda v, x: v == x, ds.In: lambda v, x: v in x, ds.StringStartsWith: lambda v, x: v.startswith(x), ds.StringEndsWith: lambda v, x: v.endswith(x),
    ds.StringContains: lambda v, x: x in v, ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x, ds.LessThanOrEqual: lambda v, x: v <= x,
}


class Reader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        if not set(self.columns) <= set(KINDS):
            raise ValueError(f"columns are of {sorted(KINDS)}")
        self.path, self.head = options["path"], int(options.get("head", HEAD))
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if isinstance(f, ds.IsNotNull) and f.attribute in (("path",), ("length",)):
                continue
            if type(f) in _PATH_TESTS and f.attribute in (("path",), ("length",)):
                self.tests.append((int(f.attribute == ("length",)), type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[Group]:
        system, inside, before = _system(self.path)
        info = system.get_file_info(inside)
        found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(inside, recursive=True))
        files = sorted((before + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_")))
        groups: list[list[tuple[str, int]]] = []
        held = TASK_BYTES
        for file in files:
            if all(_PATH_TESTS[kind](file[at], value) for at, kind, value in self.tests):
                if held >= TASK_BYTES or len(groups[-1]) >= TASK_FILES:
                    groups.append([])
                    held = 0
                groups[-1].append(file)
                held += file[1] if "content" in self.columns else min(file[1], self.head) + SNIFF
        return [Group(g) for g in groups]

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        system = _system(self.path)[0]
        before = _system(self.path)[2]
        rows, held = [], 0
        for name, length in partition.files if partition else []:
            row = self._row(system, name, name[len(before) :], length)
            rows.append(row)
            held += sum(len(row[c] or b"") for c in ("head", "content"))
            if held >= HELD_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, system: arrow_fs.FileSystem, name: str, inside: str, length: int) -> dict:
        """A file's columns; one that cannot be read any more has a name and a length only."""
        row = dict.fromkeys(KINDS) | {"path": name, "length": length, "bytes_read": 0}
        try:
            with system.open_input_file(inside) as file:
                whole = "content" in self.columns
                if whole or {"head", "frame", "bytes_read"} & set(self.columns):
                    ranges = Ranges(file, length, length if whole else self.head)
                    row |= {"head": ranges.head[: self.head], "content": ranges.head if whole else None}
                    if "frame" in self.columns and ranges.head[:3] == b"\xff\xd8\xff":
                        row["frame"] = jpeg_frame(ranges.read, length)
                    row["bytes_read"] = ranges.bytes_read
        except OSError:
            pass
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], KINDS[c]) for c in self.columns], names=self.columns)


class Written(ds.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(ds.DataSourceArrowWriter):
    """Files from rows (path, content); a path is relative to the folder. A file appears under its name when it is complete; a task that runs
    again writes the same files. Rows of null content give no file."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        if not {"path", "content"} <= set(schema.fieldNames()):
            raise ValueError("files are written from columns path and content")
        self.path = options["path"]
        if overwrite:
            system, inside, _ = _system(self.path)
            system.delete_dir_contents(inside, missing_dir_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root, _ = _system(self.path)
        names = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if not content.is_valid:
                    continue
                steps = (path or "").split("/")
                if not all(steps) or ".." in steps:
                    raise ValueError(f"no relative path: {path}")
                folder = "/".join([root.rstrip("/"), *steps[:-1]])
                system.create_dir(folder, recursive=True)
                name = f"{folder}/{steps[-1]}"
                begun = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(begun) as out:
                    out.write(content.as_buffer())
                system.move(begun, name)
                names.append(name)
        return Written(names)

    def abort(self, messages: list[Written | None]) -> None:
        system = _system(self.path)[0]
        for name in [n for m in messages if m for n in m.names]:
            if system.get_file_info(name).type == arrow_fs.FileType.File:
                system.delete_file(name)


class ImageFiles(ds.DataSource):
    """Options: path, a folder (read recursively) or a file; head, the bytes of `head`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageFiles)
    return spark


def read(spark: SparkSession, path: str, columns: Sequence[str] = ("path", "length", "head", "frame"), head: int = HEAD) -> DataFrame:
    """`columns` of the files under `path`; only with `content` are files read whole."""
    kinds = dict(c.strip().split(" ") for c in SCHEMA.split(","))
    return register(spark).read.format(FORMAT).option("head", head).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)


def write(files: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (path, content) as files under the folder `path`."""
    register(files.sparkSession)
    files.select("path", "content").write.format(FORMAT).mode(mode).save(path)


def formats() -> dict[str, tuple[bool, bool]]:
    """(can be loaded, can be saved) for each registered format."""
    return {f: (f in codecs.LOADERS, f in codecs.SAVERS) for f in sorted({*codecs.LOADERS, *codecs.SAVERS})}
