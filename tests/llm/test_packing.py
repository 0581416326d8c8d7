import gc
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reviewloom.llm import packing
from reviewloom.llm.common import tokenizer_path
from reviewloom.session import BATCH_BYTES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def expected_pieces(tokenizer, rows, capacity):
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((i, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_pieces_and_places(documents, awkward, tokenizer):
    got = packing.pack_documents(documents(awkward), tokenizer_path()).collect()
    mine = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr)
    assert mine == expected_pieces(tokenizer, awkward, 4096)
    n, least = check_places(got, 4096)
    assert n <= least + 1


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = ["don't", "It's!", "a.b", "x''s", "Ω", "Σας", "e\u0301", "\u0301", "12", "½", "<|endoftext|>", "<|END", "…", "日本",
             "\x1c", "\x85", "\u2028", "\xa0", "'", "'LL", "_", "ab_c", "A-B", "(x)", "!!!", "ÀÉ", "straße", "İ", "ǅ", "🙂", "\x00"]
    ids = packing.WordIds(tokenizer_path())
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(1, 12)))
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == expected, repr(text)


def test_known_words_take_little_memory(tokenizer):
    words = [f"{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(100_000, 300_000)]
    ids = packing.WordIds(tokenizer_path())
    gc.collect()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, len(words), 10_000):
        ids.of_all(pa.array([" ".join(words[i : i + 10_000]).encode()], pa.binary()))
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 64 * len(words)
    assert np.frombuffer(ids.of(words[-1].encode()), "<u4").tolist() == tokenizer.encode(words[-1], add_special_tokens=False).ids


def test_known_words_are_bounded_and_those_in_use_stay():
    asked = []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    known = packing._Known(100)
    for turn in range(40):
        words = ["often", "a" * 65, *(f"{turn}-{i}" for i in range(30))]
        assert known.of(pa.array(words), encode).to_pylist() == [w.encode() for w in words]
        assert len(known.words) == len(known.ids) == len(known.uses) <= 100
    assert asked.count("often") == 1 and asked.count("a" * 65) == 40
    assert known.of(pa.array([], pa.string()), encode).to_pylist() == []
    one_at_once = packing._Known(2)
    assert one_at_once.of(pa.array(["a", "b", "c"]), encode).to_pylist() == [b"a", b"b", b"c"]
    assert len(one_at_once.words) == 0


def test_texts_are_sent_in_small_batches(spark, documents, monkeypatch, tokenizer):
    sent = packing._tokenize

    def small(path, capacity, end_id):
        run = sent(path, capacity, end_id)

        def checked(batches):
            for batch in batches:
                assert batch.num_rows < 10, batch.num_rows
                yield from run(iter([batch]))

        return checked

    monkeypatch.setattr(packing, "_tokenize", small)
    before = spark.conf.get(BATCH_BYTES)
    rows = [(i, "ab " * 300_000) for i in range(12)] + [(12, None), (13, "ab " * 2_000_000)]
    got = packing.pack_documents(documents(rows).coalesce(1), tokenizer_path()).groupBy("doc_id").sum("length").collect()
    one = len(tokenizer.encode("ab", add_special_tokens=False).ids)
    assert sorted(map(tuple, got)) == [(i, 300_000 * one + 1) for i in range(12)] + [(12, 1), (13, 2_000_000 * one + 1)]
    assert spark.conf.get(BATCH_BYTES) == before


def test_many_chunks_and_rounds(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(1, 900), rng.randint(500, 1000), 1000])) for i in range(2500)]
    pieces = spark.createDataFrame(rows, "row long, length long")
    got = pieces.join(packing.pack(pieces, 1000, 200), "row").collect()
    assert sorted((r.row, r.length) for r in got) == rows
    n, least = check_places(got, 1000)
    # pieces of more than half a sequence never share one
    large = sum(length > 500 for _, length in rows)
    assert n <= max(least, large) * 1.02 + 2


def test_pieces_that_never_fit_together_end(spark):
    pieces = spark.createDataFrame([(i, 600) for i in range(900)], "row long, length long")
    assert check_places(pieces.join(packing.pack(pieces, 1000, 100), "row").collect(), 1000)[0] == 900


def test_the_search_goes_on_while_it_saves_sequences(spark):
    """Pieces of 1,100 to 1,700 tokens: best fit wastes a part of every sequence."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1100, 1700)) for i in range(1200)]
    pieces = spark.createDataFrame(rows, "row long, length long")
    n, _ = check_places(pieces.join(packing.pack(pieces, 4096), "row").collect(), 4096)
    lengths = [length for _, length in rows]
    plain = packing.best_fit(sorted(range(len(rows)), key=lambda i: -lengths[i]), lengths, [], 4096)
    assert n < 0.992 * len(plain)


def test_crossover_and_evolution_keep_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, 300).tolist()
    first = packing.best_fit(list(range(300)), lengths, [], 1000)
    second = packing.best_fit(list(range(299, -1, -1)), lengths, [], 1000)
    for child in (packing.crossover(first, second, lengths, 1000, rng), packing.mutation(first, lengths, 1000, rng)):
        assert sorted(i for b in child for i in b) == list(range(300))
        assert max(sum(lengths[i] for i in b) for b in child) <= 1000
    before = packing.fitness(first, lengths, 1000)
    best = packing.evolve(lengths, [first, second], 1000, 60, 4, 1)[0]
    assert packing.fitness(best, lengths, 1000) > before


def test_no_rows(documents):
    assert packing.pack_documents(documents([]), tokenizer_path()).count() == 0
