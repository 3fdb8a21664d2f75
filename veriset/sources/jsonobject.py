"""Entries of large JSON objects, read in byte ranges by many tasks.

Where a range begins, only what came before tells whether it is inside a text and how deep. So every range is scanned twice:
first for what it does to each possible state, which is three small rows, then, with its real state, for its entries.
An entry belongs to the range that holds the comma or brace before it; its task reads on to the end of the entry.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OUTSIDE, INSIDE, ESCAPED = range(3)
#: Bytes of a range, and of what is read on at a time.
RANGE, AHEAD = 32 << 20, 1 << 20
_TOKEN = re.compile(rb'["\[\]{},]')
_TEXT = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_OPEN_TEXT = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)


def scan(data: bytes, mode: int, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, byte, mode, depth) of every bracket and comma outside texts, with the depth behind it; the last one is the end (byte 0)."""
    at = 0
    while True:
        if mode == ESCAPED:
            if not data:
                break
            at, mode = 1, INSIDE
        if mode == INSIDE:
            whole = _TEXT.match(data, at)
            if whole is None:
                end = _OPEN_TEXT.match(data, at).end()
                mode = ESCAPED if data[end : end + 1] == b"\\" else INSIDE
                break
            at, mode = whole.end(), OUTSIDE
        token = _TOKEN.search(data, at)
        if token is None:
            break
        byte, at = data[token.start()], token.end()
        if byte == 0x22:
            mode = INSIDE
            continue
        depth += (byte in b"[{") - (byte in b"]}")
        yield token.start(), byte, OUTSIDE, depth
    yield len(data), 0, mode, depth


class _Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int, mode: int = OUTSIDE, depth: int = 0) -> None:
        super().__init__(number)
        self.number, self.path, self.start, self.end, self.mode, self.depth = number, path, start, end, mode, depth


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path, a folder's in name order, with their lengths."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(where))
        return [(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name[0] not in "._"]
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [(info.path, info.size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("size", RANGE))
        self.states = json.loads(options["states"]) if "states" in options else None

    def partitions(self) -> list[InputPartition]:
        ranges = []
        for path, length in _files(self.path):
            for start in range(0, length, self.size):
                state = self.states[len(ranges)] if self.states else (OUTSIDE, 0)
                ranges.append(_Range(len(ranges), path, start, min(length, start + self.size), *state))
        return ranges

    def read(self, part: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.path) as source:
            data = source.read_at(part.end - part.start, part.start)
            if self.states is None:
                for mode in (OUTSIDE, INSIDE, ESCAPED):
                    *_, (_, _, end, delta) = scan(data, mode, 0)
                    yield part.number, part.start, mode, end, delta
            else:
                yield from self._entries(source, data, part)

    @staticmethod
    def _entries(source, data: bytes, part: _Range) -> Iterator[tuple[str, str | None]]:
        opened = None  # the place behind the comma or brace before the entry
        mode, depth, base = part.mode, part.depth, 0
        length, held = source.size(), data
        while True:
            for at, byte, mode, depth in scan(data, mode, depth):
                # commas of the object, its opening and its closing brace
                border = (depth == 1 and byte in b",{") or (depth == 0 and byte == 0x7D)
                if not (byte and border):
                    continue
                if opened is not None:
                    yield from _entry(held[opened : base + at])
                    opened = None
                if byte != 0x7D and base + at < part.end - part.start:
                    opened = base + at + 1
                elif base + at >= part.end - part.start:
                    return
            if opened is None:
                return
            base = len(held)
            if part.start + base >= length:
                raise ValueError(f"{part.path} ends inside an entry.")
            data = source.read_at(min(AHEAD, length - part.start - base), part.start + base)
            held += data


def _entry(text: bytes) -> Iterator[tuple[str, str | None]]:
    if text.strip():
        for key, value in json.loads(b"{" + text + b"}").items():
            yield key, value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class JsonObjectSource(DataSource):
    """(identifier, value) of JSON objects: texts as they are, other values as JSON."""

    @classmethod
    def name(cls) -> str:
        return "veriset_json_object"

    def schema(self) -> str:
        return "identifier string, value string" if "states" in self.options else "number int, start bigint, mode int, ends int, depth bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def json_object(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(identifier, value) of a file that is one JSON object, or of a folder of such files. A repeated key gives a row each time.

    The driver gets three rows per range and sums up the states from them. A file that ends early fails the read.
    """
    spark.dataSource.register(JsonObjectSource)
    reader = spark.read.format(JsonObjectSource.name()).option("path", path).option("size", size)
    effects = {(r.number, r.mode): r for r in reader.load().collect()}
    states: list[tuple[int, int]] = []
    mode, depth = OUTSIDE, 0
    for number in range(len(effects) // 3):
        if effects[number, OUTSIDE].start == 0:
            mode, depth = OUTSIDE, 0
        states.append((mode, depth))
        effect = effects[number, mode]
        mode, depth = effect.ends, depth + effect.depth
    return reader.option("states", json.dumps(states)).load()
