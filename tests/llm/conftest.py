import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use themselves, as columns of the input.
CLASHING = (
    "row", "text_sha256", "kept", "group_size", "keep_id", "n_points", "digest", "node", "signature", "bucket",
    "hits", "items", "n_words", "score", "held_out", "length", "piece", "block", "_row", "_sha", "_raw", "token",
    "_gone_id", "_any", "gone", "stays", "text_", "quality", "word", "run", "n", "run_id", "lang_pred", "bin", "sequence_id",
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in CLASHING),
    ]
)

WORDS = "the of and river stone glass with under paper light seven morning slowly window across green".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) pairs as a table with every column of documents and names that clash."""

    def make(rows, partitions=3):
        full = [
            (i, text, None if i is None else ("en", "fr", None)[i % 3], None, None, *(["x"] * len(CLASHING)))
            for i, text in rows
        ]
        return spark.createDataFrame(full, DOCUMENT).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Rows with every kind of trouble: no id, no text, white space only, copies, near copies, one very long text."""
    base = prose(1, 120)
    long_ = prose(2, 60_000)
    shared = prose(3, 30)
    rows = [
        (10, base),
        (3, base),
        (4, base.replace(" ", "  ")),
        (4, base.replace(" ", "  ")),
        (5, base + " and one more word"),
        (6, None),
        (7, ""),
        (8, " \t\r\n\x0b\x0c "),
        (9, "one two"),
        (9, "one two"),
        (11, "ONE  two"),
        (None, base),
        (None, "nothing like the others at all"),
        (None, None),
        (12, long_),
        (13, long_[:200_000] + " changed " + long_[200_000:]),
        (14, f"{prose(4, 40)}\n{shared}\n{prose(5, 40)}"),
        (15, f"{prose(6, 40)}\n{shared}"),
        (16, f"  {shared.upper()}\t\n\n{prose(7, 10)}"),
        (17, f"{shared}\n{shared}\n"),
        (18, f"{prose(8, 5)}\n{shared}\r"),
        (19, f"\n{shared}"),
        (20, "Ünïcödé 日本語 текст über straße 𝒳𝒴𝒵 " + prose(9, 20)),
        (21, "a" * 5000),
        (22, "b" + "a" * 300 + "c"),
        (23, "12 345 &&& !!"),
        (24, "日本語のテキスト"),
        (-1, shared),
        (25, "<|endoftext|> it's don't 1234 x<|startoftext|>y …  z\x1c!\x1d!"),
    ]
    return rows + [(100 + i, prose(50 + i % 7, 60)) for i in range(40)]
