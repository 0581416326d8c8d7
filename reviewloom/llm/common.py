"""Small helpers shared by the corpus operators."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def utf8(column) -> Column:
    """The text as UTF-8 bytes, NULL as none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def tokenizer_path() -> str:
    """The vocabulary file that the installed tokenizers bring along; a parameter wherever it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one column ``row``, so that no name of its own can clash with a new one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def in_order(column) -> Column:
    """A key that sorts by ``column`` with NULL last."""
    column = F.col(column) if isinstance(column, str) else column
    return F.struct(column.isNull().alias("missing"), column.alias("value"))


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes=8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds little more than ``most_bytes`` of ``text``.

    A worker lives on after its task: what Arrow has set free with each batch goes back to the machine.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The rows, at least one, as a batch."""
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pyarrow_uri(path: str) -> str:
    """The path as pyarrow names it, where Hadoop has a scheme of its own for the same store."""
    scheme, _, rest = path.partition(":")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme in ("wasb", "wasbs"):
        return f"abfs{scheme[4:]}:{rest.replace('.blob.', '.dfs.', 1)}"
    if scheme == "dbfs":
        return f"/dbfs/{rest.lstrip('/')}"
    return path


def filesystem(path: str):
    """The file system of a path or URI that all executors reach, and the place in it.

    Credentials come from the executors' environment: pyarrow does not read Hadoop's settings.
    """
    path = pyarrow_uri(path)
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
