"""CSV with line ends inside quotes, read by byte ranges.

Whether a line end closes a record depends on all quotes before it. A first
pass counts the quotes of each range; their running sum per file tells for each
range whether it begins inside quotes. In the second pass a range yields the
records that begin in it, reading on past its end for the last one. So a file
of any size is read by as many tasks as it has ranges, and no record is read
twice or lost. Both passes are one Python data source whose partitions are the
ranges; the fields are cut by Spark's own CSV parser.
"""

import csv
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset  # noqa: F401
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reviewloom.session import stage_path

# the executors need pyarrow and numpy, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 * 1024 * 1024
_CHUNK = 4 * 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024

#: In place of a table of ranges: every file is one, and begins outside quotes.
WHOLE_FILES = "whole files"

#: Hadoop's names of stores that pyarrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss", "wasb": "abfss"}


def filesystem(path: str):
    """The file system of a path or URI, and the place in it; ValueError for a store that pyarrow does not know."""
    scheme, colon, rest = path.partition(":/")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "dbfs":
        return fs.LocalFileSystem(), f"/dbfs/{rest.lstrip('/')}"
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:/{rest}")
    except (pa.ArrowInvalid, NotImplementedError) as error:
        raise ValueError(f"no reader of byte ranges for {scheme}: {error}") from error


def csv_files(path: str):
    """The file system and the data files of a path with their sizes, in order; hidden ones are none."""
    store, place = filesystem(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
    files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return store, sorted(files)


def records(source, start: int, stop: int, inside: bool, chunk_bytes=_CHUNK) -> Iterator[bytes]:
    """The records that begin in bytes ``start`` to ``stop`` of an open file; ``inside``: whether ``start`` is in quotes."""
    source.seek(max(start - 1, 0))
    wanted = start == 0 or source.read(1) == b"\n" and not inside
    parts, base, parity = [], start, int(inside)
    while chunk := source.read(chunk_bytes):
        data = np.frombuffer(chunk, np.uint8)
        quotes, lines = np.flatnonzero(data == 0x22), np.flatnonzero(data == 0x0A)
        begin = 0
        for end in lines[(parity + np.searchsorted(quotes, lines)) % 2 == 0].tolist():
            if wanted:
                yield b"".join([*parts, chunk[begin:end]])
            parts, begin, wanted = [], end + 1, True
            if base + begin >= stop:
                return
        if wanted:
            parts.append(chunk[begin:])
        base, parity = base + len(chunk), parity + len(quotes)
    if wanted and (last := b"".join(parts)):
        yield last


def header_names(record: bytes) -> list[str]:
    return next(csv.reader([record.decode("utf-8-sig").removesuffix("\r")], strict=True))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    inside: bool = False


class _QuoteCounts(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options["range_bytes"])

    def partitions(self):
        _, files = csv_files(self.path)
        return [Range(p, at, min(at + self.size, size)) for p, size in files for at in range(0, size, self.size)]

    def read(self, partition):
        store, _ = filesystem(self.path)
        quotes = 0
        with store.open_input_file(partition.path) as source:
            source.seek(partition.start)
            left = partition.stop - partition.start
            while left and (chunk := source.read(min(left, _CHUNK))):
                quotes += chunk.count(b'"')
                left -= len(chunk)
        yield partition.path, partition.start, partition.stop, quotes


class _Records(DataSourceReader):
    def __init__(self, options):
        self.path, self.ranges, self.columns = options["path"], options["ranges"], json.loads(options["columns"])

    def partitions(self):
        if self.ranges == WHOLE_FILES:
            return [Range(path, 0, size) for path, size in csv_files(self.path)[1] if size]
        store, place = filesystem(self.ranges)
        rows = pa.dataset.dataset(place, filesystem=store, format="parquet").to_table().to_pylist()
        return [Range(r["path"], r["start"], r["stop"], r["inside"]) for r in rows]

    def read(self, partition):
        store, _ = filesystem(self.path)
        schema = pa.schema([("record", pa.string())])
        with store.open_input_file(partition.path) as source:
            found = records(source, partition.start, partition.stop, partition.inside)
            if partition.start == 0 and (names := header_names(next(found, b""))) != self.columns:
                raise ValueError(f"{partition.path} has columns {names} instead of {self.columns}")
            held, size = [], 0
            for record in found:
                record = record.removesuffix(b"\r")
                if not record:  # an empty line is no record
                    continue
                held.append(record.decode("utf-8", "replace"))
                size += len(record)
                if size > _BATCH_BYTES:
                    yield pa.record_batch([pa.array(held, pa.string())], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(held, pa.string())], schema=schema)


class QuotedCsv(DataSource):
    """Format ``quoted_csv``: the quotes of each range, or with the option ``ranges`` the records."""

    @classmethod
    def name(cls):
        return "quoted_csv"

    def schema(self):
        return "record string" if "ranges" in self.options else "path string, start long, stop long, quotes long"

    def reader(self, schema):
        return _Records(self.options) if "ranges" in self.options else _QuoteCounts(self.options)


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, range_bytes=RANGE_BYTES) -> DataFrame:
    """A CSV table with a header, in UTF-8, from plain files; every ``range_bytes`` of a file are a task of their own.

    Every file begins with the names of ``schema`` in its order, or it is an
    error; without a schema the first file gives the names, and all is text.
    Quoted fields may hold commas, line ends and doubled quotes; empty fields
    are NULL, empty lines nothing; line ends inside a field stay as they are. A
    record may be longer than a range: the task in which it begins reads it.
    """
    spark.dataSource.register(QuotedCsv)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    store, files = csv_files(path)
    if schema is None:
        filled = [name for name, size in files if size]
        if not filled:
            raise ValueError(f"no CSV data with a header in {path}")
        with store.open_input_file(filled[0]) as source:
            names = header_names(next(records(source, 0, 1, False)))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    source = spark.read.format("quoted_csv").option("path", path)
    ranges = WHOLE_FILES
    if any(size > range_bytes for _, size in files):
        ranges = stage_path(spark, "csv-ranges")
        in_file = Window.partitionBy("path").orderBy("start")
        before = F.sum("quotes").over(in_file) - F.col("quotes")
        counted = source.option("range_bytes", str(range_bytes)).load()
        counted.select("path", "start", "stop", (before % 2 == 1).alias("inside")).write.parquet(ranges)
    rows = source.option("ranges", ranges).option("columns", json.dumps(schema.names)).load()
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return rows.select(F.from_csv("record", schema.toDDL(), options).alias("r")).select("r.*")
