import re
from collections import Counter

import pytest

from reviewloom.llm import decontamination

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected_overlap(rows, items):
    windows = []
    for item, text in items:
        w = found_words(text)
        windows += [(item, w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w]
    out = []
    for i, text in rows:
        w, hit, names = found_words(text), set(), set()
        for item, window in windows:
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    names |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


ITEMS = [
    (1, prose(700, 40)),
    (2, prose(700, 20) + " " + prose(701, 9)),
    (10, "one two"),
    (11, "Straße日本 42"),
    (12, ""),
    (13, None),
    (14, "..."),
    (None, prose(702, 14)),
    (1, prose(700, 40)),
    (15, "la " * 30),
]


@pytest.fixture
def rows(awkward):
    def inside(text, a, b):
        return " ".join(text.split()[a:b])

    return [r for r in awkward if r[0] not in (12, 13)] + [
        (500, prose(800, 100) + " " + inside(ITEMS[0][1], 3, 18).upper().replace(" ", " -- ")),
        (501, prose(800, 400) + " " + inside(ITEMS[0][1], 0, 13)),
        (502, inside(ITEMS[0][1], 0, 12)),
        (503, "x STRASSE straße日本 42 y one\ntwo"),
        (504, prose(803, 50) + " " + ITEMS[7][1]),
        (505, "la " * 50 + "lala"),
        (506, inside(ITEMS[1][1], 10, 29) + " " + ITEMS[0][1]),
    ]


@pytest.mark.parametrize("most_bits", [2**28, 64])
@pytest.mark.parametrize("shingle", [4, 1])
def test_overlap_equals_brute_force(spark, documents, rows, most_bits, shingle):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, hits string")
    got = decontamination.benchmark_overlap(documents(rows), items, shingle=shingle, most_bits=most_bits).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got)
    expected = expected_overlap(rows, ITEMS)
    assert got == expected and sum(r[4] for r in expected) >= 4


def test_dropping_and_empty_tables(spark, documents, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(rows)
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    expected = Counter(r[0] for r in expected_overlap(rows, ITEMS).elements() if not r[4])
    assert Counter(r.doc_id for r in left.collect()) == expected
    assert decontamination.benchmark_overlap(documents([]), items).count() == 0
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_a_very_long_text(spark, documents):
    text = prose(5, 200_000)
    items = [(1, " ".join(text.split()[150_000:150_020]))]
    got = decontamination.benchmark_overlap(documents([(1, text)]), spark.createDataFrame(items, "item_id long, text string"))
    (row,) = got.collect()
    assert row.n_hit >= 20 and not row.contaminated and row["items"] == ["1"]


def test_a_benchmark_larger_than_the_documents(spark, documents):
    """Thousands of items over few words; most windows occur nowhere, a third of the documents share a passage."""
    items = [(i, prose(10_000 + i, 25)) for i in range(1500)]
    shared = items[7][1]
    rows = [(i, prose(i, 60) + (" " + shared if i % 3 == 0 else "")) for i in range(120)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.benchmark_overlap(documents(rows), table).collect()
    hits = {r.doc_id: (r.n_hit, r["items"]) for r in got if r.n_hit}
    assert hits == {i: (25, ["7"]) for i, _ in rows if i % 3 == 0}


def test_items_that_share_a_window_are_all_listed(spark, documents):
    text = prose(4, 13)
    items = spark.createDataFrame([(i, text) for i in range(300)], "item_id long, text string")
    (row,) = decontamination.benchmark_overlap(documents([(1, text)]), items).collect()
    assert row["items"] == sorted(map(str, range(300))) and row.n_hit == 13
