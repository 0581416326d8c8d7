"""Benchmark passages in documents, by a prefix-filtered set join.

The windows of the benchmark items are sets of word shingles. A document that
contains a window contains all its shingles, so one of them, the window's
rarest in the corpus, is prefix enough. Windows and shingle counts are tables;
positions of shingles in documents meet the windows in a join on the rarest
shingle. A position bounds where the window must start and whether it can end
inside the document; what is left is verified word by word. A bit table of
bounded size keeps shingles that no window has from being sent at all.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8, whole_rows
from reviewloom.llm.shingles import WordHash, shingle_hashes
from reviewloom.session import stage

WINDOW = 13
SHINGLE = 4
#: Bits for a shingle in the bit table, and the most it may have (32 MB). Fuller tables let more through, and lose nothing:
#: one in so many shingles of the documents passes without being wanted.
BITS_PER_SHINGLE, MOST_BITS = 1024, 2**28
#: Shingles that a task counts before it sends the counts on.
_COUNTED = 200_000
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WINDOWS = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.binary())), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
_CANDIDATE = pa.struct([("shingle", pa.int64()), ("position", pa.int32()), ("before", pa.int32()), ("context", pa.list_(pa.binary()))])
_FOUND = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("candidates", pa.list_(_CANDIDATE))])


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def _windows(window, shingle):
    """Every window of an item with its shingles; all of a shorter item is one window, fewer words are one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in slices(batches, "text", 200_000):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                size = min(shingle, len(found))
                hashes = shingle_hashes(cache.of(found), size).view(np.int64).tolist() if found else []
                for i in range(max(1, len(found) - window + 1) if found else 0):
                    rows.append((item_id, found[i : i + window], size, hashes[i : i + window - size + 1]))
            if rows:
                yield record_batch(rows, _WINDOWS)

    return run


class BitTable:
    """Which shingles are wanted, by some bits of their hash; ``sizes``: the shingle lengths that occur."""

    def __init__(self, shingles: DataFrame, most_bits):
        """``shingles``: size and shingle. The driver gets at most ``most_bits`` / 64 numbers."""
        facts = shingles.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("size")).alias("sizes")).first()
        bits = 64
        while bits < min(most_bits, BITS_PER_SHINGLE * facts.n):
            bits *= 2
        cell = F.shiftrightunsigned("shingle", 64 - bits.bit_length() + 1)
        bit = F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")
        cells = shingles.select(cell.alias("cell")).groupBy(F.floor(F.col("cell") / 64).cast("long").alias("word"))
        self.sizes, self.shift = facts.sizes, np.uint64(64 - bits.bit_length() + 1)
        self.table = np.zeros(bits // 64, np.uint64)
        for row in cells.agg(F.bit_or(bit).alias("mask")).toLocalIterator():
            self.table[row.word] = np.uint64(row.mask % 2**64)

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Where a shingle may be wanted."""
        cell = hashes >> self.shift
        return np.flatnonzero(self.table[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1))


def _count(wanted: BitTable):
    """Documents that contain each wanted shingle, summed in the task."""

    def sums(held):
        shingles, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return shingles, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = WordHash(), [], 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                hashes = cache.of(words(text))
                for length in wanted.sizes:
                    own = shingle_hashes(hashes, length)
                    own = np.unique(own[wanted.positions(own)])
                    if len(own):
                        held.append((own, np.ones(len(own), np.int64)))
                        size += len(own)
            if size > _COUNTED:
                held = [sums(held)]
                size = len(held[0][0])
                if size > _COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], schema=_COUNTS)
                    held, size = [], 0
        if held:
            shingles, n = sums(held)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], schema=_COUNTS)

    return run


def _candidates(wanted: BitTable, window):
    """Each text's words and the places of its wanted shingles, with the words around that a window can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in slices(batches, "text", 2_000_000):
            rows = []
            for text in batch.column("text").to_pylist():
                found = words(text)
                hashes, places = cache.of(found), []
                for length in wanted.sizes:
                    own = shingle_hashes(hashes, length)
                    for at in wanted.positions(own).tolist():
                        start = max(0, at - window + length)
                        places.append((int(own[at].view(np.int64)), at, at - start, found[start : at + window]))
                rows.append((len(found), [dict(zip(("shingle", "position", "before", "context"), p, strict=True)) for p in places]))
            n_words, places = zip(*rows, strict=True)
            columns = [batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(places, _FOUND.types[2])]
            arrays = [*columns, *(batch.column(c) for c in batch.schema.names if c not in ("text", "digest"))]
            names = [*_FOUND.names, *(c for c in batch.schema.names if c not in ("text", "digest"))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def window_tables(benchmark: DataFrame, window=WINDOW, shingle=SHINGLE):
    """The distinct windows (window_id, words, size, shingles), and the items of each (window_id, item_id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text"))
    rows = items.mapInArrow(_windows(window, shingle), "item_id string, words array<binary>, size int, shingles array<long>")
    # words hold no space, so that joined words are one window's only
    joined = F.array_join(F.transform("words", lambda w: F.hex(w)), " ")
    rows = stage(rows.withColumn("window_id", F.unhex(F.sha2(joined, 256))), "window-rows")
    distinct = rows.groupBy("window_id").agg(F.first(F.struct("words", "size", "shingles")).alias("w")).select("window_id", "w.*")
    names = rows.filter("item_id IS NOT NULL").select("window_id", "item_id").distinct()
    return stage(distinct, "windows"), names


def rarest_shingles(windows: DataFrame, texts: DataFrame, most_bits=MOST_BITS) -> DataFrame:
    """Each window that can occur with its rarest shingle over all ``texts`` and that one's place; staged.

    Windows with a shingle that no document has cannot occur and are left out.
    """
    parts = windows.select("window_id", "size", F.posexplode("shingles").alias("place", "shingle"))
    wanted = BitTable(parts.select("size", "shingle").distinct(), most_bits)
    counts = texts.select("text").mapInArrow(_count(wanted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = (
        parts.join(counts, "shingle", "left")
        .groupBy("window_id")
        .agg(F.min(F.struct("n", "shingle", "place")).alias("r"), F.count_if(F.col("n").isNull()).alias("absent"))
        .filter("absent = 0")
    )
    chosen = windows.join(rarest, "window_id").select("window_id", "words", "size", F.col("r.shingle").alias("shingle"), F.col("r.place").alias("place"))
    return stage(chosen, "window-prefixes")


def _occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """digest, window_id, start and stop of every place where a window occurs; ``found``: candidates of texts."""
    places = found.select("digest", "n_words", F.explode("candidates").alias("c")).select("digest", "n_words", "c.*")
    # copies of a text have the same places
    places = places.dropDuplicates(["digest", "shingle", "position"])
    length = F.size("words")
    start = F.col("position") - F.col("place")
    fits = (start >= 0) & (F.col("before") >= F.col("place")) & (start + length <= F.col("n_words"))
    same = F.slice("context", F.col("before") - F.col("place") + 1, length) == F.col("words")
    return places.join(prefixes, "shingle").filter(fits & same).select("digest", "window_id", start.alias("start"), (start + length).alias("stop"))


def _marked(docs: DataFrame, text, benchmark: DataFrame, window, shingle, most_bits, *keep):
    """``docs`` as digest, n_words and ``keep``, and for each digest with a hit n_hit and items."""
    windows, names = window_tables(benchmark, window, shingle)
    texts = docs.select(utf8(text).alias("text"), *keep).withColumn("digest", F.unhex(F.sha2("text", 256)))
    prefixes = rarest_shingles(windows, texts, most_bits)
    wanted = BitTable(prefixes.select("size", "shingle").distinct(), most_bits)
    schema = "digest binary, n_words long, candidates array<struct<shingle: long, position: int, before: int, context: array<binary>>>"
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    found = stage(texts.mapInArrow(_candidates(wanted, window), schema + kept), "places")
    hits = stage(_occurrences(found.filter(F.size("candidates") > 0), prefixes), "occurrences")
    in_text = Window.partitionBy("digest").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("digest", "start", "stop").distinct()
    new = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(in_text), F.col("start")))
    covered = spans.withColumn("new", F.greatest(new, F.lit(0))).groupBy("digest").agg(F.sum("new").alias("n_hit"))
    listed = hits.select("digest", "window_id").distinct().join(names, "window_id")
    listed = listed.groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found.drop("candidates"), covered.join(listed, "digest", "left")


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, window=WINDOW, shingle=SHINGLE, most_bits=MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and contaminated, per row of ``docs``.

    A window is ``window`` consecutive words of an item, or all of a shorter
    one. Words inside any occurrence of a window are hit; from a twentieth of
    its words on a document is contaminated. NULL and empty texts have no word,
    items without words no window; an item without id marks words but is in no
    list. An empty table on either side is no error. Rows repeated in either
    table and other columns change nothing. Copies of a text are searched once
    they have been found to hold a rare shingle.
    """
    rows = docs.select(F.col("doc_id"), "text")
    found, hits = _marked(rows, "text", benchmark, window, shingle, most_bits, "doc_id")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.join(hits, "digest", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window=WINDOW, shingle=SHINGLE, most_bits=MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns. Texts are told by their SHA-256."""
    found, hits = _marked(docs.select("text"), "text", benchmark, window, shingle, most_bits)
    gone = found.join(hits, "digest").filter(_contaminated(F.col("n_hit"), F.col("n_words"))).select("digest").distinct()
    own = F.unhex(F.sha2(utf8("row.text"), 256))
    return whole_rows(docs).join(stage(gone, "contaminated"), own == F.col("digest"), "left_anti").select("row.*")
