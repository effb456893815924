"""A streaming source of lines that are appended to text files.

An offset is how far each file has been read, always to the end of a whole line; Spark keeps offsets in the query's checkpoint, so a stream goes on after a restart where it
was. New bytes of a file are read in parts. Offsets and the listing of files are the driver's: a number a file. Files are reached by URI, so they may be in any store that executors and driver share.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidelane.sources.files import parse_logs
from tidelane.storage import open_store

SCHEMA = "file string, at long, value string"
_BLOCK = 1 << 16


class Part(InputPartition):
    """Bytes of a file; its lines are those that begin in them."""

    def __init__(self, file: str, begin: int, end: int, first: bool):
        self.file, self.begin, self.end, self.first = file, begin, end, first


def _last_line_end(file, size: int, since: int) -> int:
    """The end of the last whole line of a file, at least ``since``; looks back block by block."""
    to = size
    while to > since:
        begin = max(since, to - _BLOCK)
        file.seek(begin)
        found = file.read(to - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        to = begin
    return since


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 32 << 20))
        self.seen: dict[str, int] = {}

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        store, root = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        return {x.path: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, _ = open_store(self.path)
        out = {}
        for name, size in sorted(self._files().items()):
            since = self.seen.get(name, 0)
            since = since if since <= size else 0  # a shorter file is a new one
            with store.open_input_file(name) as file:
                out[name] = _last_line_end(file, size, since)
        self.seen = out
        return {"files": json.dumps(out)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, parts = json.loads(start["files"]), []
        for name, to in json.loads(end["files"]).items():
            since = old.get(name, 0)
            since = since if since <= to else 0
            parts += [Part(name, at, min(at + self.split, to), at == since) for at in range(since, to, self.split)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])
        with store.open_input_file(partition.file) as file:
            at = partition.begin
            if not partition.first:  # a line that has begun before is the part's before
                at = _after_newline(file, at - 1)
            rows: list[tuple] = []
            held, begin = b"", at
            while begin < partition.end:
                file.seek(begin + len(held))
                block = file.read(_BLOCK)
                *lines, rest = (held + block).split(b"\n")
                if not block:
                    lines, rest = ([rest] if rest else []), b""
                for line in lines:
                    if begin < partition.end:
                        rows.append((partition.file, begin, line.decode("utf-8", "replace").removesuffix("\r")))
                    begin += len(line) + 1
                held = rest
                if len(rows) >= 4096:
                    yield _batch(rows, schema)
                    rows = []
                if not block:
                    break
            if rows:
                yield _batch(rows, schema)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _after_newline(file, at: int) -> int:
    """The place behind the first line end from ``at`` on."""
    while True:
        file.seek(at)
        block = file.read(_BLOCK)
        found = block.find(b"\n")
        if found >= 0 or not block:
            return at + (found + 1 if found >= 0 else 0)
        at += len(block)


class LogTail(DataSource):
    """``format("log_tail")`` with ``path``, the URI of a file or folder, and ``splitbytes``, the most that a task reads at once."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogTailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """A stream (file, at, value) of the whole lines of a file or of a folder's files: each once, with the byte at which it begins. A file that gets shorter is read anew."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("splitBytes", split_bytes).load()


def tail_logs(spark: SparkSession, path: str, lateness: str = "10 minutes") -> DataFrame:
    """Appended log lines as ts, level, logger and message, with a watermark; see :func:`tidelane.sources.files.parse_logs`."""
    return parse_logs(tail(spark, path)).where(F.col("ts").isNotNull()).withWatermark("ts", lateness)
