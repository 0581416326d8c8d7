import random
import zlib
from collections import Counter

import pytest

from reviewloom.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def runs(text):
    word = ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            word += c.lower() if c.isascii() else c
        elif word:
            yield word
            word = ""


def expected(rows):
    counts = Counter()
    for i, text in rows:
        for run in runs(text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    around = {w: [v for v in n if v != w and near(w, v)] for w in n}
    best = {w: min(found, key=lambda v: (-n[v], v)) for w, found in around.items() if found}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return out


def noisy(seed, n_docs, alphabet="abc", n_words=40):
    """Few frequent words and many one or two edits from them."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 10))) for _ in range(n_words)]

    def edited(word):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", rng.choice(alphabet), word[at] + rng.choice(alphabet)]) + word[at + 1 :]
        return word or "a"

    weights = [rng.choice([1, 5, 100]) for _ in stems]
    return [(i, " ".join(edited(w) for w in rng.choices(stems, weights, k=60))) for i in range(n_docs)]


AWKWARD = [
    (None, "Straße straße STRAßE étéétéé ÉTÉÉTÉÉ"),
    (None, "wordword×÷word wordword×÷word"),
    (7, None),
    (7, ""),
    (8, "12 -- 日本語 ,"),
    (9, "repeated Repeated rEpEaTeD x"),
    (9, "repeated Repeated rEpEaTeD x"),
    (10, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + "y " + "z" * 2999 + "y"),
    (11, "aaaaaaa aaaaaaaa aaaaaaaaa aaaaaaa aaaaaaaa aaaaaaaaa"),
]


@pytest.mark.parametrize(("group_words", "partition_words"), [(5000, 20000), (3, 50)])
def test_variants_equal_brute_force(documents, group_words, partition_words):
    rows = AWKWARD + [(100 + i, text) for i, text in noisy(1, 60)]
    got = spelling.spelling_variants(documents(rows), group_words=group_words, partition_words=partition_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(expected(rows))
    assert any(r[1] for r in expected(rows))


def test_forms_are_followed_to_the_last(documents):
    rows = [(1, "abcdefg " * 3 + "abcdefgh " * 40 + "abcdefghi " * 500), (2, "abcdefghij " * 6000)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(documents(rows)).collect()}
    assert got == {tuple(e)[0]: tuple(e)[1:3] for e in expected(rows)}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij")


def test_a_group_is_split_until_small(documents):
    """All words share their beginning: a third of the vocabulary under one key."""
    rng = random.Random(5)
    rows = [(i, " ".join("sameprefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(40))) for i in range(20)]
    words = spelling.vocabulary(documents(rows))
    keys = spelling.keyed_words(words, 8).collect()
    sizes = Counter((r.group, r.high - r.low) for r in keys)
    assert all(n <= 8 for (_, width), n in sizes.items() if width > 1)
    assert Counter(map(tuple, spelling.spelling_variants(documents(rows), group_words=8).collect())) == Counter(expected(rows))


@pytest.mark.parametrize("seed", range(60))
def test_composition_accepts_each_pair_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab" if seed % 2 else "abc") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 60))})
    got = sorted(tuple(sorted(p)) for p in spelling.near_pairs(words, 0, 99))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_the_acceptor_is_minimal():
    """One state for each distinct set of continuations, as lists of arcs."""
    words = sorted(["tapped", "taps", "tap", "topped", "tops", "top", "stops"])
    machine = spelling.Acceptor(words)

    def accepted(state):
        for label, final, target, _ in machine.arcs(state):
            if final:
                yield label
            yield from (label + rest for rest in accepted(target))

    assert list(accepted(machine.start)) == words
    languages = {tuple(accepted(q)) for q in range(len(machine.label))}
    assert len(languages) == len(machine.label)


def test_no_words(documents):
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, None), (2, "short words")])).count() == 0
