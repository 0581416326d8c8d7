import re
from collections import Counter

import pytest

from reviewloom.llm import components, near_dedup

from .conftest import prose


def expected_near(rows, percent):
    def shingles(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    named = sorted({s for s, (i, _) in zip(sets, rows, strict=True) if s and i is not None}, key=lambda s: sorted(s)[0])
    parent = {s: s for s in named}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a in named:
        for b in named:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    least = {}
    for s, (i, _) in zip(sets, rows, strict=True):
        if s in parent and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    out = []
    for s, (i, _) in zip(sets, rows, strict=True):
        component = i if not s else least[root(s)] if s in parent else None
        out.append((i, len(s), component, i == component))
    return Counter(out)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(documents, awkward, percent):
    got = near_dedup.near_duplicates(documents(awkward), percent=percent).collect()
    assert Counter(tuple(r) for r in got) == expected_near(awkward, percent)


def test_chains_and_families_that_are_not_linked(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # several blocks of a bucket
    monkeypatch.setattr(near_dedup, "PARTNERS", 3)
    rows, words = [], prose(90, 400).split()
    for i in range(60):  # each differs from the next in a few words: linked in a chain, far ends are not alike
        rows.append((1000 + i, " ".join(words)))
        words[6 * i] = f"changed{i}"
    base = prose(91, 200).split()
    for i in range(40):  # all alike to about 75 percent, none linked
        own = list(base)
        for k in range(0, 200, 36):
            own[(k + i) % 200] = f"own{i}x{k}"
        rows.append((2000 + i, " ".join(own)))
    got = near_dedup.near_duplicates(documents(rows)).collect()
    assert Counter(tuple(r) for r in got) == expected_near(rows, 85)


def test_dropping_keeps_one_of_each_component(documents, awkward):
    docs = documents(awkward)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = {k[0] for k in expected_near(awkward, 85) if k[3]}
    assert {r.doc_id for r in left.collect()} == kept


def test_no_rows(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    assert near_dedup.drop_near_duplicates(documents([])).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 150)] + [(7, i) for i in range(200, 400)] + [(5, 5), (9, 8), (8, 9), (8, 9)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    expected = {i: 100 for i in range(100, 151)} | {i: 7 for i in [7, *range(200, 400)]} | {8: 8, 9: 8}
    assert sorted((r.node, r.component) for r in got) == sorted(expected.items())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
