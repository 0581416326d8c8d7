import math
import random
import zlib

import numpy as np
import pytest

from reviewloom.llm import quality

from tests.llm.conftest import prose


def junk(seed, n):
    rng = random.Random(seed)
    kind = seed % 3
    words = prose(seed, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["%%%", "***", "###"]) for w in words)
    if kind == 1:
        return " | ".join(words)
    return " ".join(w for w in words[: n // 8] for _ in range(8))


def corpus(n, seed=0):
    rng = random.Random(seed)
    texts = {i: (1, prose(i, rng.randint(20, 200))) if i % 3 else (0, junk(i // 3, rng.randint(20, 200))) for i in range(n)}
    return [(i, t) for i, (_, t) in texts.items()], [(i, q, 0) for i, (q, _) in texts.items()]


@pytest.fixture(scope="module")
def labelled(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def hashed_features(text):
    """Features of a short text, one at a time with Python's numbers."""
    def spread(v):
        v = v * 0x9E3779B1 % 2**32
        v ^= v >> 15
        return v * 0x85EBCA77 % 2**32 >> (32 - int(math.log2(quality.BUCKETS)))

    raw = b" " + text + b" "
    data = bytes(0x20 if b in b" \t\n\r\x0b\x0c" else b for b in raw)
    out = []
    for n in quality.LENGTHS:
        for i in range(len(data) - n + 1):
            if data[i] != 0x20:
                value = n * 0x27D4EB2F % 2**32
                for k in range(n):
                    value ^= data[i + k] << 8 * k
                out.append(spread(value % 2**32))
    hashes = [sum((b + 1) * pow(0x01000193, k + 1, 2**32) for k, b in enumerate(w)) % 2**32 for w in raw.split()]
    out += [spread(h ^ 0x165667B1) for h in hashes]
    out += [spread((b - a) % 2**32 ^ 0xC2B2AE3D) for a, b in zip(hashes, hashes[1:])]
    return sorted(out)


@pytest.mark.parametrize("text", ["", " ", "a", "the the  the", "Ünïcödé 日本\n\tx", "a\x0bb\x0cc d" * 5])
def test_features_equal_plain_python(text):
    raw = text.encode()
    assert sorted(np.concatenate(list(quality.features(raw))).tolist()) == hashed_features(raw)


def test_long_texts_lose_no_feature(monkeypatch):
    text = prose(3, 400).encode()
    whole = [np.sort(np.concatenate(list(quality.features(text))))]
    monkeypatch.setattr(quality, "_PIECE", 97)
    pieces = np.sort(np.concatenate(list(quality.features(text))))
    ngrams = len(text) * len(quality.LENGTHS)
    # n-grams are all there; words at the ends of pieces are counted in parts
    assert abs(len(pieces) - len(whole[0])) < ngrams * 0.01


def test_held_out_documents_are_told_apart(documents, labelled):
    rows, labels = corpus(600)
    got = quality.score_quality(documents(rows), labelled(labels)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_only_text_decides_and_held_out_labels_do_not_matter(documents, labelled):
    rows, labels = corpus(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q, _ in labels]
    one = quality.fit_quality_model(documents(rows), labelled(labels))
    other = quality.fit_quality_model(documents(rows, 7), labelled(turned))
    assert (one.weights == other.weights).all()
    again = quality.score_quality(documents([(i + 10_000, t) for i, t in rows]), labelled([]), one).collect()
    assert {r.doc_id - 10_000: r.score for r in again} == {r.doc_id: r.score for r in quality.score_quality(documents(rows), labelled([]), one).collect()}


def test_scores_equal_a_forward_pass(documents, labelled):
    rows, labels = corpus(90)
    model = quality.fit_quality_model(documents(rows), labelled(labels))
    for _, text in rows[:12]:
        found = hashed_features(text.encode())
        logits = np.mean([model.weights[b].astype(float) for b in found], axis=0) + model.bias
        e = np.exp(logits - logits.max())
        assert abs(model.score(text.encode()) - e[1] / e.sum()) < 1e-9


def test_awkward_rows(documents, awkward, labelled):
    docs = documents(awkward)
    labels = labelled([(10, 1, 0), (3, 0, 0), (3, 1, 0), (4, None, 1), (None, 1, 0), (5, 7, 0), (6, 0, 0), (6, 0, 0)])
    got = quality.score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    empty = {r.score for r, (_, t) in zip(sorted(rows, key=repr), sorted(awkward, key=repr)) if r.doc_id in (6, 7)}
    assert len(empty) == 1


def test_no_rows_and_no_labels(documents, labelled):
    assert quality.score_quality(documents([]), labelled([])).count() == 0
    assert {r.score for r in quality.score_quality(documents([(1, "x"), (2, None)]), labelled([])).collect()} == {0.5}
