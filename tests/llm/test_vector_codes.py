import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewloom.llm import vector_codes as vc


def expected(rows, entries=64, rounds=2):
    """The contract, one vector and one part at a time."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = max(16, -(-max(len(v) for *_, v in kept) // 16) * 16)
    kept = sorted(((i, label, v + [0] * (width - len(v))) for i, label, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = width // 16
    parts = [[v[p * w : (p + 1) * w] for p in range(16)] for *_, v in kept]
    books = [[parts[k][p] for k in range(min(entries, len(kept)))] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            members = defaultdict(list)
            for own in parts:
                members[nearest(own[p], books[p])[1]].append(own[p])
            for k, found in members.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    coded, by_label = [], Counter()
    for (i, label, _), own in zip(kept, parts, strict=True):
        found = [nearest(x, book) for x, book in zip(own, books, strict=True)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in coded)


def table(spark, rows, clash="x"):
    schema = "vec_id long, embedding array<float>, label int, code string, entry string, upper string, vector string, part int"
    return spark.createDataFrame([(i, v, label, clash, clash, clash, clash, 1) for i, label, v in rows], schema).repartition(4)


def floats(rows):
    """As 32-bit floats, which is what the table holds."""
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


def clustered(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, rng.choice([0, 0, 0, 1, None]), [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in rng.sample(range(10 * n), n)]


AWKWARD = [
    (5, 1, None),
    (6, 1, [0.5] * 31 + [None]),
    (7, 1, [0.5] * 31 + [float("nan")]),
    (8, None, [float("inf")] * 32),
    (None, None, [0.25] * 32),
    (9, 2, [0.25] * 32),
    (9, 2, [0.25] * 32),
    (9, 3, [-0.001] * 32),
    (10, 3, []),
    (11, 3, [1.5] * 20),
    (12, 3, [1000.0] * 32),
]


@pytest.mark.parametrize("n", [10, 63, 400])
def test_codes_equal_the_contract(spark, n):
    rows = floats(clustered(n, 32, n) + AWKWARD)
    got = vc.compress(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_ties_go_to_the_lower_index(spark):
    rows = floats([(i, 0, [random.Random(i).choice([0.0, 1.0, -1.0]) for _ in range(16)]) for i in range(150)])
    assert Counter(map(tuple, vc.compress(table(spark, rows)).collect())) == expected(rows)


def test_no_rows(spark):
    assert vc.compress(table(spark, [])).count() == 0
    assert vc.compress(table(spark, [(1, 1, None)])).count() == 0


def test_a_component_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="a component is beyond"):
        vc.compress(table(spark, [(1, 1, [3e30] * 16)])).collect()


@pytest.mark.parametrize("seed", range(8))
def test_bounds_leave_out_no_nearer_entry_and_most_scans(seed):
    """Codebooks that wander: the entry is the exact one in every round, and net moves save scans."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (500, 4))
    home = rng.integers(-300, 300, (64, 4))
    history = [home]
    state = vc.first_scan(x, home)
    scanned = total = 0
    for number in range(6):
        # entries go away and come back: sums of drifts would grow, the net way does not
        history.append(home + (rng.integers(-40, 40, (64, 4)) if number % 2 == 0 else rng.integers(-1, 2, (64, 4))))
        scanned += vc.rescan(x, history, state)
        total += 500 * len(vc.groups_of(64))
        squared = ((x[:, None].astype(np.int64) - history[-1][None]) ** 2).sum(2)
        assert (state.entry == squared.argmin(1)).all()
        own = squared[np.arange(500), state.entry]
        assert (state.upper**2 + 1e-6 >= own * (1 - 1e-9) - 1e-6).all() or (state.upper_stamp < number + 1).any()
    assert scanned < 0.8 * total
