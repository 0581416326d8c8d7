import hashlib
import re
from collections import Counter, defaultdict

import pytest

from reviewloom.llm import exact_dedup, line_dedup


def expected_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0))
    out = []
    for i, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[key])
        keep = None if best[1] else best[2]
        kept = i == keep and len(text or "") == -best[0]
        out.append((i, keep, len(groups[key]), kept, hashlib.sha256(key.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("support", [0.005, 0.04, 0.5])
def test_exact_duplicates_equal_brute_force(documents, awkward, support):
    got = exact_dedup.exact_duplicates(documents(awkward), support).drop("n_points").collect()
    assert Counter(tuple(r) for r in got) == expected_exact(awkward)


def test_frequent_digests_are_exact_and_bounded(documents):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(600)]
    digests = exact_dedup.text_digests(documents(rows, 8))
    frequent = exact_dedup.frequent_digests(digests, 0.01).collect()
    assert [(r.group_size, r.keep_id) for r in frequent] == [(200, 0)]


def test_dropping_keeps_one_row_of_each_text(documents, awkward):
    docs = documents(awkward)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    keys = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert sorted(keys) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in awkward})


def test_no_rows(documents):
    assert exact_dedup.exact_duplicates(documents([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(documents([])).count() == 0
    assert line_dedup.dedup_lines(documents([])).count() == 0


def expected_lines(rows, min_points, min_documents):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_points:
                holders[key(line)].add(i)
    keeper = {k: max(i for i in s if i is not None) for k, s in holders.items() if len(s) >= min_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return Counter(out)


@pytest.mark.parametrize(("points", "least"), [(40, 5), (3, 2), (40, 6)])
def test_line_dedup_equals_brute_force(documents, awkward, points, least):
    got = line_dedup.dedup_lines(documents(awkward), points, least).drop("kept").collect()
    expected = expected_lines(awkward, points, least)
    assert Counter(tuple(r) for r in got) == expected
    assert points == 3 or sum(r[2] for r in expected) > 0


def test_line_length_is_in_code_points(documents):
    short, long_ = "é" * 39, "é" * 40
    got = line_dedup.dedup_lines(documents([(i, f"{short}\n{long_}") for i in range(5)])).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    assert {bytes(r.kept).decode() for r in got if r.kept is not None} == {short}


def test_rows_without_an_id_lose_only_their_own_lines(documents):
    """Their lists are kept by text: none of them holds the lines of another row."""
    shared = [f"{i:03d} " + "a line that several documents hold, long enough" for i in range(30)]
    rows = [(i, "\n".join(shared)) for i in range(6)]
    rows += [(None, f"own {i}\n{shared[i]}\n{shared[i]}") for i in range(30)] + [(None, "own 0\n" + shared[0] + "\n" + shared[0])]
    got = line_dedup.dedup_lines(documents(rows)).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == expected_lines(rows, 40, 5)
