"""A data source for files of JSON lines and of marked-up texts, batch and stream.

``spark.dataSource.register(Records)`` makes the format ``records`` known.
With ``kind`` ``lines`` every line is a record, whose fields are the columns of
the stated schema; with ``files`` every file is one, with columns ``path``,
``name`` and ``text``. The columns ``year`` (from the name or the ``id`` field)
and ``file``, ``line``, ``bad`` are filled where the schema has them: ``bad`` is
a line that is no JSON object, which is left out where nobody asks for it.

Files are read in groups of about ``group_bytes``. Filters on ``year`` and
equality filters on the record's own fields are decided before a row is made;
on the year of a file's name, before the file is opened. A stream goes on at a
place in a file, behind the last whole line that it has read, so files may
grow; a line without its end waits.

Paths are those of the file systems that Arrow knows.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

FILES = "path string, name string, text string, year int"
GROUP_BYTES = 16 << 20
#: Fields that the source fills itself.
OWN = ("year", "file", "line", "bad", "path", "name", "text")
_ID_YEAR = re.compile(r"(?:^|/)(\d{2})\d{2}[.]\d{4,5}")


def year_of(name: str | None) -> int | None:
    """The year that a new-style id names."""
    found = _ID_YEAR.search(name or "")
    return 2000 + int(found.group(1)) if found else None


@dataclass
class Part(InputPartition):
    """Files with the bytes to read of each."""

    files: tuple[tuple[str, int, int], ...]


def _listing(path: str) -> tuple[object, list[tuple[str, int]]]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return system, [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    kept = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted(kept)


def _groups(files: Iterable[tuple[str, int, int]], most: int, cut: bool) -> list[Part]:
    """Parts of about ``most`` bytes; with ``cut``, a large file is read in several."""
    parts: list[Part] = []
    held: list[tuple[str, int, int]] = []
    size = 0
    for name, a, b in files:
        for start in range(a, b, most) if cut else (a,):
            stop = min(b, start + most) if cut else b
            held.append((name, start, stop))
            size += stop - start
            if size >= most:
                parts.append(Part(tuple(held)))
                held, size = [], 0
    return parts + ([Part(tuple(held))] if held else [])


_COMPARE = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
}


def _as(value: object, kind: DataType) -> object:
    """A JSON value as one of a column; null where it is none."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, IntegerType | LongType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, FloatType | DoubleType):
        return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [_as(v, kind.elementType) for v in value] if isinstance(value, list) else None
    return value


class _Reading:
    """What batch and stream share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.kind = options.get("kind", "lines")
        self.most = int(options.get("group_bytes", GROUP_BYTES))
        self.wanted: list[tuple[str, type, object]] = []

    def fits(self, name: str, value: object) -> bool:
        return all(value is not None and _COMPARE[kind](value, v) for field, kind, v in self.wanted if field == name)

    def rows(self, part: Part) -> Iterator[tuple]:
        system, _ = _listing(self.path)
        for name, start, stop in part.files:
            if self.kind == "files":
                if self.fits("year", year_of(name)) or not any(f == "year" for f, _, _ in self.wanted):
                    with system.open_input_file(name) as file:
                        text = file.read().decode("utf-8", "replace")
                    own = {"path": name, "file": name, "name": name.rsplit("/", 1)[-1], "text": text, "year": year_of(name)}
                    yield tuple(own.get(f.name) for f in self.schema.fields)
                continue
            with system.open_input_file(name) as file:
                yield from self._lines(io.BufferedReader(file), name, start, stop)

    def _lines(self, file: io.BufferedReader, name: str, start: int, stop: int) -> Iterator[tuple]:
        """Records of the lines that begin in a stretch of a file; ``line`` is the byte where one begins."""
        at = start
        if start:
            # A line that began before belongs to the stretch before.
            file.seek(start - 1)
            at = start - 1 + len(file.readline())
        file.seek(at)
        while at < stop:
            line = file.readline()
            if not line:
                return
            begin, at = at, at + len(line)
            if not line.strip():
                continue
            try:
                record = json.loads(line)
                bad = None if isinstance(record, dict) else line
            except ValueError:
                record, bad = {}, line
            if bad is not None:
                if "bad" not in self.schema.names or self.wanted:
                    continue
                record = {}
            year = year_of(record["id"]) if isinstance(record.get("id"), str) else None
            own = {"file": name, "line": begin, "bad": bad.decode("utf-8", "replace").rstrip("\n") if bad else None, "year": year}
            values = {
                f.name: own[f.name] if f.name in own and f.name not in record else _as(record.get(f.name), f.dataType) for f in self.schema.fields
            }
            if all(self.fits(field, values[field]) for field, _, _ in self.wanted):
                yield tuple(values[f.name] for f in self.schema.fields)


class RecordReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            simple = type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in self.schema.names
            name = f.attribute[0] if simple else ""
            decided = name == "year" if self.kind == "files" else simple and name not in ("file", "line", "bad")
            if not decided:
                yield f
                continue
            self.wanted.append((name, type(f), f.value))

    def partitions(self) -> list[Part]:
        _, files = _listing(self.path)
        by_year = any(f == "year" for f, _, _ in self.wanted)
        if self.kind == "files" and by_year:
            files = [(n, s) for n, s in files if self.fits("year", year_of(n))]
        return _groups(((n, 0, s) for n, s in files), self.most, self.kind == "lines") or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(partition)


class RecordStream(_Reading, DataSourceStreamReader):
    """Offsets are places in files: behind the last whole line, or the file's end for whole files."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = _listing(self.path)
        return {n: self._whole(system, n, s) for n, s in files if s}

    def _whole(self, system, name: str, size: int) -> int:
        if self.kind == "files":
            return size
        with system.open_input_file(name) as file:
            stop = size
            while stop > 0:
                start = max(0, stop - (1 << 16))
                file.seek(start)
                newline = file.read(stop - start).rfind(b"\n")
                if newline >= 0:
                    return start + newline + 1
                stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if self.kind == "files":  # a file is read once, as it is when it is first seen
            fresh = [(n, 0, e) for n, e in sorted(end.items()) if n not in start]
        else:
            fresh = [(n, start.get(n, 0), e) for n, e in sorted(end.items()) if e > start.get(n, 0)]
        return _groups(fresh, self.most, self.kind == "lines") or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(partition)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        if self.options.get("kind") != "files":
            raise ValueError("the lines' schema has to be stated")
        return FILES

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> RecordStream:
        return RecordStream(schema, dict(self.options))
