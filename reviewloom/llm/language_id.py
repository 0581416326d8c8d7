"""Language of texts: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams inside words.
A linear layer and a softmax on that mean give the languages. Stochastic
gradient descent in numpy fits both on a bounded sample of labelled rows, once
for each of a few folds; the mean of the fits is the model. Every whole text is
scored by the fit of the folds without it and its copies; these scores calibrate
the probabilities by a temperature and set the score below which a prediction is
rejected.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8, whole_rows

UNDETERMINED = "und"
#: n-gram lengths in bytes, hash buckets, embedding width.
LENGTHS, BUCKETS, WIDTH = (2, 3, 4), 2**14, 16
#: Rows a label contributes to the sample, on average; the sample has at most twice that for each label.
ROWS_PER_LABEL = 600
#: Of the right predictions of whole texts like those of the sample, so many are rejected.
REJECTED_SHARE = 0.002
#: Parts of the sample, dealt by a hash of the text, that are left out of a fit in turn.
FOLDS = 3
#: Lowest scores that give the limit where fewer than so many are below it; and how many must be, or the lowest is the limit.
TAIL, LEAST_BELOW = 10, 2
EPOCHS, RATE = 8, 0.2
#: Runs of two to five words of a text that are learned from besides the whole.
WINDOWS = 3
#: Bytes of a text whose n-grams are held at once.
_PIECE = 1_000_000

_BAGS = pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("whole", pa.bool_()), ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

# letters and bytes beyond ASCII stay, all else is a space
_LETTERS = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text; a space stands only at the ends of one."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for start in range(0, len(raw), _PIECE):  # pieces overlap, so that no n-gram is lost
        data = _LETTERS[raw[start : start + _PIECE + max(LENGTHS) - 1]]
        space, wide = data == 0x20, data.astype(np.uint32)
        for n in LENGTHS:
            count = min(len(data) - n + 1, _PIECE)
            if count <= 0:
                continue
            value, inner = wide[:count].copy(), np.zeros(count, bool)
            for i in range(1, n):
                value |= wide[i : i + count] << np.uint32(8 * i)
                if i < n - 1:
                    inner |= space[i : i + count]
            inner |= space[:count] & space[n - 1 : n - 1 + count]
            value = (value ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(15)
            yield (value * np.uint32(0xC2B2AE35) >> np.uint32(32 - int(math.log2(BUCKETS))))[~inner]


def bag(text: str):
    """The buckets of a text with their shares of its n-grams; at most ``BUCKETS`` of them."""
    counts = np.zeros(BUCKETS, np.int64)
    for found in subwords(text):
        counts += np.bincount(found, minlength=BUCKETS)
    buckets = np.nonzero(counts)[0]
    return buckets.astype(np.int32), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Scores per bucket and label (embeddings times the linear layer), temperature and limit.

    Without a bias, a text of unknown n-grams scores all labels alike.
    """

    labels: tuple[str, ...]
    weights: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for found in subwords(text):
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return _softmax(total / max(1, n) / self.temperature)


def _softmax(logits):
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(bags, n_labels, seed=7):
    """Embeddings times layer by stochastic gradient descent. ``bags``: (label number, buckets, shares)."""
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    layer = random.normal(0, 0.3, (WIDTH, n_labels))
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in random.permutation(len(bags)):
            label, buckets, shares = bags[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = shares @ embeddings[buckets]
            error = _softmax(hidden @ layer)
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            # each n-gram of a long text has a tiny share: the step is scaled to move the mean alike for all texts
            embeddings[buckets] -= rate * (shares / (shares @ shares))[:, None] * back
    return (embeddings @ layer).astype(np.float32)


def fold_of(text: str) -> int:
    """The fold of a text; copies that differ in case or white space only share it."""
    return int.from_bytes(hashlib.md5(" ".join(text.lower().split()).encode("utf-8", "replace")).digest()[:8], "big") % FOLDS


def _bags(windows):
    """The whole text of a labelled row and, for short texts' sake, ``windows`` runs of a few words from anywhere in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = raw.decode("utf-8", "replace")
                words = text.split()
                random = np.random.default_rng(len(raw))
                parts = [text]
                for _ in range(windows if len(words) > 6 else 0):
                    start = int(random.integers(0, len(words) - 5))
                    parts.append(" ".join(words[start : start + int(random.integers(2, 6))]))
                fold = fold_of(text)
                rows += [(lang, fold, i == 0, *bag(part)) for i, part in enumerate(parts) if has_letter(part)]
            if rows:
                yield record_batch(rows, _BAGS)

    return run


def learnable(docs: DataFrame):
    """Whether a row may be learned from: its id's CRC-32 modulo 4 is not 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2


def labelled_sample(docs: DataFrame, rows_per_label=ROWS_PER_LABEL):
    """About ``rows_per_label`` learnable rows of each label, chosen by a hash; and the number of labels, which are few."""
    rows = docs.filter(learnable(docs) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().collect()
    chance = F.lit(0.0)
    for row in counts:
        chance = F.when(F.col("lang") == row["lang"], F.lit(rows_per_label / row["count"])).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", F.length("text")), F.lit(2**30)) / 2**30
    return rows.filter(draw < chance).select("lang", utf8("text").alias("text")), len(counts)


def fit_language_model(docs: DataFrame, rows_per_label=ROWS_PER_LABEL) -> Model:
    """A model of the labels of ``docs``; without learnable rows one that knows no label.

    The driver holds at most twice ``rows_per_label`` rows of each label, every
    one as at most ``BUCKETS`` shares, and ``WINDOWS`` short windows of each.
    """
    sample, n_labels = labelled_sample(docs, rows_per_label)
    collected = sample.mapInArrow(_bags(WINDOWS), "lang string, fold int, whole boolean, buckets array<int>, shares array<float>")
    collected = collected.limit(max(1, 2 * rows_per_label * n_labels * (1 + WINDOWS))).toArrow()
    labels = tuple(sorted(set(collected.column("lang").to_pylist())))
    number = {label: i for i, label in enumerate(labels)}
    bags = []
    for batch in collected.to_batches():  # the arrays are views of what has arrived, no copies
        ends = batch.column("buckets").offsets.to_numpy()
        buckets, shares = (batch.column(c).values.to_numpy() for c in ("buckets", "shares"))
        facts = zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "whole")), ends[:-1], ends[1:], strict=True)
        bags += [(number[lang], buckets[a:b], shares[a:b], fold, whole) for lang, fold, whole, a, b in facts if b > a]
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1].tobytes(), *b[3:]))  # the same order whatever the partitions were
    if not bags:
        return Model((), np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    return Model(labels, *_fit_folds(bags, len(labels)))


def _fit_folds(bags, n_labels):
    """Weights, temperature and limit. ``bags``: (label number, buckets, shares, fold, whether it is a whole text)."""
    fits, logits, truth = [], [], []
    for fold in range(FOLDS):
        learned = [b[:3] for b in bags if b[3] != fold]
        apart = [b for b in bags if b[3] == fold and b[4]]
        if learned and apart:
            fits.append(_fit(learned, n_labels))
            logits += [shares @ fits[-1][buckets] for _, buckets, shares, *_ in apart]
            truth += [label for label, *_ in apart]
    if not fits:
        return _fit([b[:3] for b in bags], n_labels), 1.0, 0.0
    weights, logits, truth = np.mean(fits, axis=0).astype(np.float32), np.array(logits, np.float64), np.array(truth)
    # nothing is taken for certain: where all are right, the likelihood alone would drive the temperature to nothing
    unsure = 1 / (len(truth) + 2)
    wanted = np.full(logits.shape, unsure / max(1, n_labels - 1))
    wanted[np.arange(len(truth)), truth] = 1 - unsure
    temperature = float(
        min(
            np.geomspace(0.05, 20, 60),
            key=lambda t: -(wanted * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum(axis=1).mean(),
        )
    )
    right = logits[logits.argmax(axis=1) == truth] / temperature
    return weights, temperature, rejection_limit(right) if n_labels > 1 and len(right) else 0.0


def rejection_limit(logits, share=REJECTED_SHARE) -> float:
    """The score that ``share`` of right predictions with these logits stay below.

    It is a quantile of the log odds. Where fewer than ``TAIL`` rows are below
    it, the lowest ``TAIL`` are taken as an exponential tail. Where ``share`` is
    fewer than ``LEAST_BELOW`` rows, the sample cannot tell it: the lowest score
    is the limit then, which rejects less.
    """
    ordered = np.sort(logits, axis=1)
    odds = np.sort(ordered[:, -1] - np.log(np.exp(ordered[:, :-1] - ordered[:, -1:]).sum(axis=1)) - ordered[:, -1])
    below = share * len(odds)
    tail = odds[:TAIL]
    if below >= len(tail):
        limit = odds[int(below)]
    elif below < LEAST_BELOW:
        limit = tail[0]
    else:
        limit = tail[-1] - (tail[-1] - tail).mean() * math.log(len(tail) / below)
    return float(1 / (1 + math.exp(-limit)))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, held_out, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                text = raw.decode("utf-8", "replace")
                label, score = UNDETERMINED, 0.0
                if model.labels and has_letter(text):
                    p = model.probabilities(text)
                    label, score = model.labels[int(p.argmax())], float(min(p.max(), 1.0))
                rows.append((doc_id, held_out, label, score))
            yield record_batch(rows, _SCORES)

    return run


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, per row of ``docs``.

    A text that is NULL or has no letter is ``und`` with score 0, and so is all
    where no row could be learned from. ``rejected`` holds for those and for
    scores below the calibrated limit, which ``REJECTED_SHARE`` sets. Whole texts are read, long ones piece by
    piece. Rows without doc_id count as not held out, rows without ``lang`` are
    not learned from but predicted. Repeated rows are predicted each; an empty
    table gives no row; other columns are not read.
    """
    model = model or fit_language_model(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learnable(docs)).alias("held_out"), utf8("text").alias("text"))
    found = texts.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < model.limit)
    return found.withColumn("rejected", rejected)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns; no shuffle."""
    model = model or fit_language_model(docs)

    def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.compute.struct_field(batch.column("row"), "text")
        return batch.append_column("text", texts.cast(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(map(with_text, batches), "text"):
            keep = []
            for raw in batch.column("text").to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                keep.append(bool(model.labels) and has_letter(text) and bool(model.probabilities(text).max() >= model.limit))
            yield batch.select(["row"]).filter(pa.array(keep))

    # the text goes to Python within its row alone, not a second time beside it
    rows = whole_rows(docs)
    return rows.mapInArrow(run, rows.schema).select("row.*")
