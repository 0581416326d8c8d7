"""Quality of texts: learned vectors of hashed words and character n-grams, averaged per document, and a softmax.

Words, pairs of neighbouring words and character n-grams are hashed to one
table of vectors. A document is the mean of the vectors of its features; a
linear layer and a softmax give the probability of the good label. Stochastic
gradient descent in numpy fits vectors and layer on a bounded sample of
labelled rows. Case, digits and signs are kept: they tell good text from bad.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import slices, utf8

#: Lengths of n-grams in bytes, hash buckets, width of the vectors.
LENGTHS, BUCKETS, WIDTH = (1, 2, 3, 4), 2**15, 8
#: Labelled rows that are learned from: about so many, at most twice as many.
SAMPLE_ROWS = 3_000
EPOCHS, RATE = 6, 0.2
#: Bytes of a text whose features are held at once.
_PIECE = 1_000_000

_BAGS = pa.schema([("quality", pa.int32()), ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

_SHIFT = np.uint32(32 - int(math.log2(BUCKETS)))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _spread(value: np.ndarray) -> np.ndarray:
    value = value.astype(np.uint32) * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    return value * np.uint32(0x85EBCA77) >> _SHIFT


def _word_hashes(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each word: the sum of its bytes times powers of an odd number."""
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint32)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)  # places in ``inside`` where words start
    lengths = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    return np.add.reduceat((data[inside].astype(np.uint32) + np.uint32(1)) * powers[place], first, dtype=np.uint32)


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the features of a text, long ones piece by piece.

    A pair of words is hashed as the difference of their hashes, so that a
    word that repeats the one before it is one feature, whatever the word.
    """
    before = None
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    for start in range(0, len(raw), _PIECE):
        data = raw[start : start + _PIECE + max(LENGTHS) - 1]  # pieces overlap, so that no n-gram is lost
        space, wide = _SPACE[data], np.where(_SPACE[data], 0x20, data).astype(np.uint32)
        for n in LENGTHS:
            count = min(len(data) - n + 1, _PIECE)
            if count > 0:
                value = np.full(count, n, np.uint32) * np.uint32(0x27D4EB2F)
                for i in range(n):
                    value ^= wide[i : i + count] << np.uint32(8 * i)
                yield _spread(value[~space[:count]])
        # words that go on in the next piece are counted there in part: at most one a million bytes
        hashes = _word_hashes(data[:_PIECE], space[:_PIECE])
        yield _spread(hashes ^ np.uint32(0x165667B1))
        pairs = np.diff(hashes if before is None else np.concatenate([before, hashes]))
        yield _spread(pairs ^ np.uint32(0xC2B2AE3D))
        before = hashes[-1:] if len(hashes) else before


def bag(text: bytes):
    """Buckets of a text and their shares of its features; at most ``BUCKETS`` of them."""
    counts = np.zeros(BUCKETS, np.int64)
    for found in features(text):
        counts += np.bincount(found, minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


def _softmax(logits):
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Logits of the labels 0 and 1 by bucket (vectors times layer) and their bias."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        total, n = np.zeros(2), 0
        for found in features(text):
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return float(_softmax(total / max(1, n) + self.bias)[1])


def fit(bags, seed=5) -> Model:
    """Stochastic gradient descent; ``bags``: (label, buckets, shares)."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    layer, bias = random.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in random.permutation(len(bags)):
            label, buckets, shares = bags[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = shares @ vectors[buckets]
            error = _softmax(hidden @ layer + bias)
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            if len(buckets):
                # the shares of a long text are tiny: the step is scaled to move the mean alike for all texts
                vectors[buckets] -= rate * (shares / (shares @ shares))[:, None] * back
    return Model((vectors @ layer).astype(np.float32), bias)


def held_out(docs: DataFrame):
    """Whether a row is never learned from: its id's CRC-32 modulo 3 is 1. So is a row without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [bag(text) for text in batch.column("text").to_pylist()]
        columns = [batch.column("quality").cast(pa.int32()), *(pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), _BAGS.types[1:], strict=True))]
        yield pa.RecordBatch.from_arrays(columns, schema=_BAGS)


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample_rows=SAMPLE_ROWS) -> Model:
    """A model of ``labels.quality``, 1 against 0; without labelled rows every score is 0.5.

    An id with labels of both kinds is not learned from. About ``sample_rows``
    of the labelled ids are drawn by a hash; the driver holds at most twice as
    many bags of at most ``BUCKETS`` shares.
    """
    learnable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(labels))
    labelled = learnable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    labelled = labelled.filter(F.col("quality") == F.col("_most")).select("_id", "quality")
    chance = min(1.0, sample_rows / max(1, labelled.count()))
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(2**30)) < int(chance * 2**30))
    texts = docs.select(F.col("doc_id").alias("_doc"), utf8("text").alias("text"))
    rows = texts.join(drawn, F.col("_doc") == F.col("_id")).select("quality", "text")
    table = rows.mapInArrow(_bags, "quality int, buckets array<int>, shares array<float>").limit(2 * sample_rows).toArrow()
    bags = [
        (row["quality"], np.array(row["buckets"], np.int32), np.array(row["shares"], np.float32))
        for batch in table.to_batches(500)
        for row in batch.to_pylist()
    ]
    if not bags:
        return Model(np.zeros((BUCKETS, 2), np.float32), np.zeros(2))
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes()))  # the same order whatever the partitions were
    return fit(bags)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = [model.score(text) for text in batch.column("text").to_pylist()]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], schema=_SCORES)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on), per row of ``docs``.

    Only the text is scored; whole texts are read, long ones piece by piece.
    NULL and empty texts get the score of a text without features, which the
    bias gives. Rows without an id are held out and scored; repeated rows are
    scored each; an empty table gives no row; other columns are not read.
    """
    model = model or fit_quality_model(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), utf8("text").alias("text"))
    return texts.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
