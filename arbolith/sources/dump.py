"""Plain-text database dumps: rows of `COPY table (columns) FROM stdin;` blocks, read by splits as a Spark data source.

A first job finds the lines that begin and end blocks, split by split; these few are put in order on the driver, which settles where the
table's blocks lie (a line of data that looks like a beginning lies inside a block). A second job reads only those bytes, split by split: a
split has the lines that begin in it. Fields are apart by tabs, `\\N` is null, and backslashes escape as the format says.
Paths are local, or URIs of file systems that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SPLIT, ROWS = 64 << 20, 8192
HEAD = re.compile(rb"COPY ([^\s(]+) \(([^)]*)\) FROM stdin;\r?\n?")
# Fixed values of the format.
ESCAPES = {b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}
ESCAPED = re.compile(rb"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.S)


def _put_right(m: re.Match) -> bytes:
    c = m[1]
    if c[:1] == b"x" and len(c) > 1:
        return bytes([int(c[1:], 16)])
    if c.isdigit() and c[:1] < b"8":
        return bytes([int(c, 8) & 255])
    return ESCAPES.get(c, c)


def field(raw: bytes) -> str | None:
    """A field's value; null for \\N."""
    if raw == b"\\N":
        return None
    return (ESCAPED.sub(_put_right, raw) if b"\\" in raw else raw).decode("utf-8", "replace")


def _names(columns: bytes) -> list[str]:
    return [c.strip().strip('"') for c in columns.decode().split(",") if c.strip()]


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        files, path = fs.FileSystem.from_uri(path)
    else:
        files = fs.LocalFileSystem()
    return files.open_input_file(path)


def lines(path: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at or after `begin` and before `end`."""
    with _open(path) as f:
        at = begin
        if begin:
            f.seek(begin - 1)
            at = begin - 1
        held = b""
        skip = begin > 0  # up to the end of the line that the byte before lies in
        while at < end or held:
            cut = held.find(b"\n")
            while cut < 0:
                more = f.read(1 << 20)
                if not more:
                    break
                held += more
                cut = held.find(b"\n")
            line = held if cut < 0 else held[: cut + 1]
            if not line:
                return
            if at >= end:
                return
            if not skip:
                yield at, line
            skip, at, held = False, at + len(line), held[len(line) :]


class Split(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


def _splits(begin: int, end: int, size: int) -> list[Split]:
    return [Split(b, min(b + size, end)) for b in range(begin, end, size)]


class MarkReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        with _open(self.path) as f:
            return _splits(0, f.size(), self.split)

    def read(self, part: Split) -> Iterator[tuple]:
        for at, line in lines(self.path, part.begin, part.end):
            if line.rstrip(b"\r\n") == b"\\.":
                yield (at, at + len(line), None, None)
            elif line[:5] == b"COPY " and (m := HEAD.fullmatch(line)):
                yield (at, at + len(line), m[1].decode(), m[2].decode())


class MarkSource(DataSource):
    """Beginnings and ends of a dump's blocks."""

    @classmethod
    def name(cls) -> str:
        return "dump_marks"

    def schema(self) -> str:
        return "at long, next long, name string, columns string"

    def reader(self, schema: StructType) -> MarkReader:
        return MarkReader(self.options["path"], int(self.options.get("split", SPLIT)))


class RowReader(DataSourceReader):
    def __init__(self, path: str, blocks: list[tuple[int, int]], width: int, split: int):
        self.path, self.blocks, self.width, self.split = path, blocks, width, split

    def partitions(self) -> list[Split]:
        return [s for b, e in self.blocks for s in _splits(b, e, self.split)] or [Split(0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[f"c{i}" for i in range(self.width)])

        for at, line in lines(self.path, part.begin, part.end):
            raw = line.rstrip(b"\n").removesuffix(b"\r").split(b"\t")
            if len(raw) != self.width:
                raise ValueError(f"the row at byte {at} has {len(raw)} fields instead of {self.width}")
            rows.append([field(x) for x in raw])
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class RowSource(DataSource):
    """Rows of given byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "dump_rows"

    def schema(self) -> StructType:
        return StructType([StructField(f"c{i}", StringType()) for i in range(int(self.options["width"]))])

    def reader(self, schema: StructType) -> RowReader:
        blocks = [tuple(map(int, b.split("-"))) for b in self.options["blocks"].split(",") if b]
        return RowReader(self.options["path"], blocks, int(self.options["width"]), int(self.options.get("split", SPLIT)))


def blocks(spark: SparkSession, path: str, split: int = SPLIT) -> dict[str, tuple[list[str], list[tuple[int, int]]]]:
    """Of each table of a dump its columns and the byte ranges of its rows. The driver gets two rows for each block."""
    spark.dataSource.register(MarkSource)
    out: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}
    inside = None
    for r in spark.read.format("dump_marks").option("split", split).load(path).orderBy("at").toLocalIterator():
        if inside is None and r["name"] is not None:
            inside = r
        elif inside is not None and r["name"] is None:
            columns, ranges = out.setdefault(inside["name"], (_names(inside["columns"].encode()), []))
            ranges.append((inside["next"], r["at"]))
            inside = None
    if inside is not None:
        raise ValueError(f"the rows of {inside['name']} don't end")
    return out


def read_dump(spark: SparkSession, path: str, table: str, split: int = SPLIT) -> DataFrame:
    """The rows of a table (`name`, or `schema.name`), all columns as strings."""
    found = blocks(spark, path, split)
    names = [n for n in found if n == table or n.split(".")[-1] == table]
    if len(names) != 1:
        raise ValueError(f"{table} isn't one of the dump's tables: {', '.join(found)}")
    columns, ranges = found[names[0]]
    spark.dataSource.register(RowSource)
    rows = spark.read.format("dump_rows").option("width", len(columns)).option("blocks", ",".join(f"{b}-{e}" for b, e in ranges if e > b)).option("split", split).load(path)
    return rows.toDF(*columns)
