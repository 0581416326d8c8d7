"""Lines that many documents share, kept in one document only."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8
from reviewloom.session import stage

MIN_POINTS = 40
MIN_DOCUMENTS = 5

_LINES = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("sha256", pa.string()), ("keys", pa.list_(pa.binary()))])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])


def line_key(line: bytes, min_points: int) -> bytes | None:
    """The 128-bit hash of the normalised line; None where it has too few code points."""
    key = line.strip().lower()  # of bytes: only ASCII white space and only A-Z
    if len(key) < min_points or len(key) < 4 * min_points and len(key.decode("utf-8", "replace")) < min_points:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _keys(min_points):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = text.split(b"\n")
                keys = {line_key(line, min_points) for line in lines} - {None}
                rows.append((doc_id, len(lines), hashlib.sha256(text).hexdigest(), sorted(keys)))
            yield record_batch(rows, _LINES)

    return run


def _drop(min_points):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "dropped")), strict=True):
                gone, lines = set(keys), text.split(b"\n")
                kept = [line for line in lines if line_key(line, min_points) not in gone]
                rows.append((doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            yield record_batch(rows, _KEPT)

    return run


def shared_lines(lines: DataFrame, min_documents=MIN_DOCUMENTS) -> DataFrame:
    """Line hashes in at least ``min_documents`` documents, with the largest doc_id that holds each.

    The first grouping takes hash and document together, so a line of a third
    of the corpus is spread over all tasks; the second meets partial counts.
    """
    pairs = lines.select("doc_id", F.explode("keys").alias("line")).distinct()
    counts = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return counts.filter(F.col("n") >= min_documents).select("line", "keeper")


def dedup_lines(docs: DataFrame, min_points=MIN_POINTS, min_documents=MIN_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the kept text (binary ``kept``; NULL where nothing was dropped).

    A line's key is the line without white space at its ends and with A-Z in
    lower case. Keys of at least ``min_points`` code points that at least
    ``min_documents`` documents hold lose all lines but those of the largest
    doc_id. Rows under one doc_id count as one document, and rows without one
    together as one that is never the largest. NULL and empty texts are one
    empty line; an empty table gives no row; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    lines = stage(
        texts.mapInArrow(_keys(min_points), "doc_id long, n_lines long, sha256 string, keys array<binary>"), "lines"
    )
    shared = stage(shared_lines(lines, min_documents), "shared_lines")
    # a list is one text's, so that the lines of rows without an id do not come together
    dropped = (
        lines.select("doc_id", "sha256", F.explode("keys").alias("line"))
        .join(shared, "line")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("dropped_id"), F.col("sha256").alias("dropped_sha"))
        .agg(F.collect_set("line").alias("dropped"))
    )
    dropped = stage(dropped, "dropped_lines")
    touched = F.col("doc_id").eqNullSafe(F.col("dropped_id")) & (F.col("sha256") == F.col("dropped_sha"))
    # by a shuffle whatever the size: the list of documents grows with the corpus
    changed = texts.withColumn("sha256", F.sha2("text", 256)).join(dropped.hint("merge"), touched)
    changed = changed.select("doc_id", "text", "dropped")
    changed = changed.mapInArrow(_drop(min_points), "doc_id long, n_lines long, n_dropped long, kept binary")
    whole = lines.join(dropped.select("dropped_id", "dropped_sha"), touched, "left_anti").select(
        "doc_id",
        "n_lines",
        F.lit(0).cast("long").alias("n_dropped"),
        F.col("sha256").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return whole.unionByName(
        changed.select(
            "doc_id",
            "n_lines",
            "n_dropped",
            F.sha2("kept", 256).alias("kept_sha256"),
            "kept",
        )
    )
