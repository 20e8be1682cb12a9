"""Log files that are still written to, as a Spark data source in batch and stream.

    spark.dataSource.register(GrowingLog)
    spark.readStream.format("growing_log").option("glob", "*.log*").load("/shared/logs")

Rows are non-empty lines: ``value`` (bytes), ``modified`` and ``file`` of the file, and ``start``, the line's place in
it in bytes. Lines end at line feeds or carriage returns.

An offset of the stream says for every file how many bytes of whole lines have been given, and a digest of the file's
first bytes. An unfinished last line stays back until it is ended. From two offsets follow the bytes in between:

* a file whose first bytes are the same goes on where it was left;
* a file of another name with the first bytes of one that is no longer there was renamed, or copied before it
  was cut, and goes on where that one was left;
* a file with other first bytes, or with fewer bytes than were given, was begun anew and is read from its start.

Ranges are cut into splits of ``splitBytes`` at line ends, one task each, and are read again by the same offsets after
a failure, under the name the file has by then. If its bytes are gone, the stream stops, or goes on without them where
``failOnDataLoss`` is ``false``. A batch read gives whole files, the unfinished last lines included.

Not told apart: a file cut and refilled between two looks with the same first kilobyte and at least as many bytes.
A file that leaves the folder and comes back later is a new one. Paths may be URIs of stores that pyarrow knows; they have to
be readable under the same name on every executor.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value binary, modified timestamp, file string, start bigint"
HEAD_BYTES = 1024
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20
_BATCH_ROWS = 10_000

_ARROW = pa.schema([("value", pa.binary()), ("modified", pa.timestamp("us", "UTC")), ("file", pa.string()), ("start", pa.int64())])


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes ``begin`` to ``end`` of a file whose lines are read from ``first`` to ``last``."""

    path: str
    modified: int
    first: int
    last: int
    begin: int
    end: int


class _Folder:
    """Files of a path that match a pattern, and bytes of them."""

    def __init__(self, path: str, glob: str) -> None:
        if "://" not in path and not path.startswith("file:"):
            path = os.path.abspath(path)
        self.files, self.path = pafs.FileSystem.from_uri(path)
        self.glob = glob

    def listed(self) -> list[pafs.FileInfo]:
        here = self.files.get_file_info(self.path)
        if here.type == pafs.FileType.File:
            return [here]
        found = self.files.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)
                       and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def bytes_of(self, path: str, begin: int, end: int) -> bytes:
        with self.files.open_input_file(path) as file:
            file.seek(begin)
            return file.read(end - begin)

    def head(self, path: str, n: int) -> str | None:
        """A digest of the first ``n`` bytes; None if there are not so many."""
        try:
            data = self.bytes_of(path, 0, n)
        except FileNotFoundError:
            return None
        return hashlib.sha256(data).hexdigest() if len(data) == n else None

    def whole_lines(self, path: str, size: int) -> int:
        """Bytes up to the last line feed."""
        end = size
        while end > 0:
            begin = max(end - _CHUNK, 0)
            at = self.bytes_of(path, begin, end).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        return 0


def _micros(file: pafs.FileInfo) -> int:
    return (file.mtime_ns or 0) // 1000


def _splits(path: str, modified: int, first: int, last: int, size: int) -> list[Range]:
    return [Range(path, modified, first, last, at, min(at + size, last)) for at in range(first, last, size)]


class _Lines:
    """Reads ranges on the executors."""

    def __init__(self, options: dict[str, str]) -> None:
        # names of options come without regard to case
        self.folder = _Folder(options["path"], options.get("glob", "*"))
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        values, starts, held = [], [], 0
        for at, line in self._lines(part):
            values.append(line)
            starts.append(at)
            held += len(line)
            if len(values) == _BATCH_ROWS or held >= 4 * _CHUNK:
                yield _batch(part, values, starts)
                values, starts, held = [], [], 0
        if values:
            yield _batch(part, values, starts)

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        with self.folder.files.open_input_file(part.path) as file:
            # a split begins behind the first line feed at or after the byte before it
            at = part.begin - (part.begin > part.first)
            inside = part.begin == part.first
            file.seek(at)
            held: list[bytes] = []
            line_at, read_to = at, at
            while read_to < part.last and line_at < part.end:
                chunk = file.read(min(_CHUNK, part.last - read_to))
                if not chunk:
                    break
                read_to += len(chunk)
                *ended, rest = chunk.split(b"\n")
                for line in ended:
                    line = b"".join([*held, line])
                    held = []
                    if inside:
                        if line_at >= part.end:
                            return
                        yield from _parts(line_at, line)
                    inside = True
                    line_at += len(line) + 1
                held.append(rest)
            if inside and line_at < part.end:
                yield from _parts(line_at, b"".join(held))


def _parts(at: int, line: bytes) -> Iterator[tuple[int, bytes]]:
    if b"\r" not in line:
        if line:
            yield at, line
        return
    for found in re.finditer(rb"[^\r]+", line):
        yield at + found.start(), found.group()


def _batch(part: Range, values: list[bytes], starts: list[int]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([
        pa.array(values, pa.binary()), pa.array([part.modified] * n, pa.timestamp("us", "UTC")),
        pa.array([part.path] * n, pa.string()), pa.array(starts, pa.int64())], schema=_ARROW)


class _WholeFiles(_Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for f in self.folder.listed() for r in _splits(f.path, _micros(f), 0, f.size, self.split_bytes)]


class _Growing(_Lines, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.seen: dict[str, dict] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """What can be read now; equal to the last one if no line was ended since."""
        now = {}
        for file in self.folder.listed():
            try:
                at = self.folder.whole_lines(file.path, file.size)
            except FileNotFoundError:  # renamed since it was listed: the next look finds it
                continue
            n = min(at, HEAD_BYTES)
            head = self.folder.head(file.path, n) if at else None
            if head is None:
                continue
            before = self.seen.get(file.path, {})
            same = before.get("at") == at and before.get("head") == head
            now[file.path] = before if same else {"at": at, "n": n, "head": head, "modified": _micros(file)}
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        left = dict(start)
        begins = {}
        for path, entry in end.items():
            if path in left and self._goes_on(left[path], path, entry):
                begins[path] = left.pop(path)["at"]
        # files that were cut: what is left of them may have been copied, else they begin anew
        for path, entry in end.items():
            if path not in begins:
                old = next((p for p, e in left.items() if e["at"] <= entry["at"] and self._same(e, path, entry)), None)
                begins[path] = left.pop(old)["at"] if old is not None else 0
        out = []
        for path, entry in sorted(end.items(), key=lambda item: (item[1]["modified"], item[0])):
            if begins[path] < entry["at"]:
                here = self._located(path, entry)
                if here is not None:
                    out += _splits(here, entry["modified"], begins[path], entry["at"], self.split_bytes)
        return out

    def _goes_on(self, before: dict, path: str, entry: dict) -> bool:
        return before["at"] <= entry["at"] and self._same(before, path, entry)

    def _same(self, before: dict, path: str, entry: dict) -> bool:
        """Whether the file of ``entry`` begins with the bytes of one seen before."""
        if before["n"] == entry["n"]:
            return before["head"] == entry["head"]
        here = self._located(path, entry) if before["n"] < entry["n"] else None
        return here is not None and self.folder.head(here, before["n"]) == before["head"]

    def _located(self, path: str, entry: dict) -> str | None:
        """The name that a file of an offset has now."""
        names = [path] + [f.path for f in self.folder.listed() if f.size >= entry["at"] and f.path != path]
        for name in names:
            if self.folder.head(name, entry["n"]) == entry["head"] and self.folder.files.get_file_info(name).size >= entry["at"]:
                return name
        if self.strict:
            raise FileNotFoundError(f"{path}: bytes that were to be read are gone (failOnDataLoss=false goes on without them)")
        return None


class GrowingLog(DataSource):
    """``growing_log``; options ``path``, ``glob``, ``splitBytes``, ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WholeFiles(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Growing(self.options)
