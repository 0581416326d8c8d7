import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import suffix_dedup

from .conftest import prose


def expected_spans(rows):
    least = {}
    no_id = 2**63
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(least.get(w, no_id), no_id if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < (no_id if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check(df, rows):
    got = suffix_dedup.drop_repeated_passages(df).collect()
    assert Counter(tuple(r) for r in got) == expected_spans(rows)


def test_awkward_rows_equal_brute_force(documents, awkward):
    check(documents(awkward, 5), awkward)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps_equal_brute_force(documents, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 50)
    rng = random.Random(seed)
    pool = [prose(1000 * seed + i, 40) for i in range(6)]
    rows = []
    for i in rng.sample(range(10_000), 60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 60)
            parts.append(rng.choice([p[a : a + rng.randint(45, 120)], prose(rng.random(), 5), "ab" * rng.randint(1, 60), "é" * 40]))
        rows.append((i, "".join(parts)))
    check(documents(rows, 4), rows)


def test_long_texts_are_cut_without_loss():
    text = (prose(3, 3000) + "x" * 500 + prose(3, 3000)).encode()
    whole, cut = list(suffix_dedup.cells_of([text])), list(suffix_dedup.cells_of([text], 777))
    assert len(whole) == 1 and len(cut) > 30
    for cells in (whole, cut):
        windows = sorted(w for c in cells for s, n in zip(c.start, c.count, strict=True) for w in range(s, s + n))
        assert windows == list(range(len(text) - 49))
    assert all(c.content(i) == text[c.start[i] : c.start[i] + c.count[i] + 49] for c in cut for i in range(len(c.start)))


def test_multikey_order_is_lexicographic():
    tokens = np.random.default_rng(0).integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_order(tokens)
    assert [tuple(r) for r in tokens[order]] == sorted(map(tuple, tokens))


def test_kept_texts_and_no_rows(documents):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(1, a + b), (2, c + b[:-3] + a)]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.drop_repeated_passages(documents(rows), texts=True).collect()}
    assert got[1] == a + b and got[2].startswith(c) and a not in got[2]
    assert suffix_dedup.drop_repeated_passages(documents([])).count() == 0
    assert suffix_dedup.drop_repeated_passages(documents([(1, None), (None, "short")])).count() == 2


def test_a_hot_token_is_dealt_out_window_by_window(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 50)
    monkeypatch.setattr(suffix_dedup, "HOT_CELLS", 20)
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOWS", 200)
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 100)
    line = prose(1, 12)
    rows = [(i if i % 50 else None, f"{prose(1000 + i, 9)}\n{line}\n{prose(5000 + i // 2, 9)}") for i in range(200)]
    check(documents(rows, 4), rows)

    raw = documents(rows, 4).select("doc_id", suffix_dedup.utf8("text").alias("text"))
    blocks = suffix_dedup.stage(raw.mapInArrow(suffix_dedup._number, suffix_dedup._ddl(suffix_dedup._BLOCKS)), "blocks")
    cells, _ = suffix_dedup.repeated_cells(blocks, np.empty(0, np.uint64))
    sizes = cells.groupBy("bucket").agg(suffix_dedup.F.sum(suffix_dedup.F.octet_length("several")).alias("n")).collect()
    hot = [r.n for r in sizes if r.bucket > 0]  # with no splitter, all cells were in bucket 0
    assert len(hot) > 10 and max(hot) < sum(hot) / 5
