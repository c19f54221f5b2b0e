"""A streaming source of lines of log files that grow: every complete line comes out once.

An offset holds, for each file, how far it is read, the header lines in effect there and a number that goes up
when the file is written anew. A batch takes lines that are complete, in the order of paths, up to a number of
rows and bytes; what is admitted is looked through once for line ends and headers when the batch is planned, and
read where the batch runs, one partition per file. Spark's own log of offsets decides what a batch is, so a
batch that runs again gives the same lines.

Spark asks a source of this kind for its newest offset without saying where the stream stands. So that a limit
counts from there after a restart too, each offset is noted in the folder `progress` before it is handed out.
Files that are gone leave the offset.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tailed_log"
COLUMNS = ("_file", "_offset", "_separator", "_fields", "_raw")
SCHEMA = "_file string, _offset bigint, _separator string, _fields string, _raw string"
STEP = 1 << 20
LINES = 10_000
SEPARATOR, FIELDS = b"#separator", b"#fields"
START = [0, None, None, 0]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def _lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Complete lines of a stretch of a file with the place behind each."""
    file.seek(start)
    rest, at = b"", start
    while at + len(rest) < end:
        data = file.read(min(STEP, end - at - len(rest)))
        if not data:
            return
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            at += len(line) + 1
            yield at, line


def _headers(line: bytes, separator: str | None, fields: str | None) -> tuple[str | None, str | None]:
    text = line.rstrip(b"\r").decode("utf-8", "replace")
    if line.startswith(SEPARATOR):
        return text, fields
    return (separator, text) if line.startswith(FIELDS) else (separator, fields)


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, separator: str | None, fields: str | None):
        self.path, self.start, self.end, self.separator, self.fields = path, start, end, separator, fields


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.rows, self.bytes = int(options.get("maxrows", 0)) or None, int(options.get("maxbytes", 0)) or None
        self.progress = options.get("progress")
        if self.progress is None and (self.rows or self.bytes):
            raise ValueError("a limit per batch needs a folder for the stream's progress")
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _note(self) -> tuple[fs.FileSystem, str]:
        files, folder = filesystem(self.progress)
        return files, f"{folder.rstrip('/')}/offset.json"

    def _last(self) -> dict:
        if self.known is None:
            self.known = {}
            if self.progress is not None:
                files, note = self._note()
                if files.get_file_info(note).type == fs.FileType.File:
                    with files.open_input_stream(note) as file:
                        self.known = json.loads(file.read())
        return self.known

    def latestOffset(self) -> dict:
        last, now = self._last(), {}
        files, folder = filesystem(self.folder)
        rows, size = self.rows, self.bytes
        found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda x: x.path):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            at, separator, fields, turn = last.get(info.path, START)
            if info.size < at:
                at, separator, fields, turn = 0, None, None, turn + 1
            if info.size > at and (rows is None or rows > 0) and (size is None or size > 0):
                begin = at
                with files.open_input_file(info.path) as file:
                    for after, line in _lines(file, at, info.size):
                        # a line longer than what is left of the bytes is taken if it is the first
                        if size is not None and after - begin > size and at > begin:
                            break
                        if line.startswith(b"#"):
                            separator, fields = _headers(line, separator, fields)
                        elif rows is not None:
                            if rows == 0:
                                break
                            rows -= 1
                        at = after
                if size is not None:
                    size -= at - begin
            now[info.path] = [at, separator, fields, turn]
        if self.progress is not None and now != last:
            files, note = self._note()
            files.create_dir(note.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(note) as file:
                file.write(json.dumps(now).encode())
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (at, _, _, turn) in sorted(end.items()):
            begin, separator, fields, before = start.get(path, START)
            if turn != before:
                begin, separator, fields = START[:3]
            if at < begin:
                raise ValueError(f"the noted progress of {path} is older than the stream's")
            if at > begin:
                out.append(_Stretch(path, begin, at, separator, fields))
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.folder)
        separator, fields = partition.separator, partition.fields
        schema = pa.schema([(c, pa.int64() if c == "_offset" else pa.string()) for c in COLUMNS])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

        with files.open_input_file(partition.path) as file:
            for after, line in _lines(file, partition.start, partition.end):
                if line.startswith(b"#"):
                    separator, fields = _headers(line, separator, fields)
                    continue
                raw = line.rstrip(b"\r").decode("utf-8", "replace")
                held.append((partition.path, after - len(line) - 1, separator, fields, raw))
                if len(held) == LINES:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class TailedLog(DataSource):
    """Options: path, glob, maxRows, maxBytes, progress."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
