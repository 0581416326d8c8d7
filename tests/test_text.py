import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as X
from reviewloom.functions.gate import ACCEPTED, EMPTY_MESSAGE, REJECTED, domain_gate

# Input, tokens, tokens after stop words.
GOLDEN = [
    ("I hate this product.", "hate this product", "hate product"),
    ("Battery life is terrible.", "battery life is terrible", "battery life terrible"),
    (
        "After eating this product, I am not feeling well.",
        "after eating this product am not feeling well",
        "eating product not feeling well",
    ),
    ("I do not like this product.", "do not like this product", "not like product"),
    ("I never liked this product.", "never liked this product", "never liked product"),
    ("I don't like this product.", "do not like this product", "not like product"),
    ("I don’t like this product.", "do not like this product", "not like product"),
    ("n't", "", ""),
    ("he said don''t", "he said don", "said don"),
    ("Can't won't SHAN'T", "cannot will not shall not", "cannot will not shall not"),
    ("see <b>bold</b> http://a.b/c?d now", "see bold now", "see bold now"),
    (None, "", ""),
    ("   ", "", ""),
]


def expected_clean(text):
    """The cleaning rules with the regular expressions of Python."""
    t = (text or "").lower()
    for pattern, by in (
        (r"\bcan['’]t\b", "cannot"),
        (r"\bwon['’]t\b", "will not"),
        (r"\bshan['’]t\b", "shall not"),
        (r"\b(\w+)n['’]t\b", r"\1 not"),
    ):
        t = re.sub(pattern, by, t)
    expanded = t
    for pattern in (r"<.*?>", r"http\S+|www\S+|https\S+", r"[^a-zA-Z\s]", r"\b[a-zA-Z]\b", r"\s+"):
        t = re.sub(pattern, " ", t)
    return expanded, t.strip()


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_golden_traces(spark):
    df = rows(spark, [g[0] for g in GOLDEN]).withColumn("tokens", X.tokenize("t"))
    got = df.select(
        "id", F.array_join("tokens", " "), F.array_join(X.remove_stopwords("tokens"), " ")
    ).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [g[1:] for g in GOLDEN]


def test_cleaning_equals_python_on_hostile_strings(spark):
    rng = random.Random(7)
    parts = [
        "n't", "n’t", "can", "won", "shan", "a", "b", "é", "don", " ", "\n", "\r", "\xa0", "\x1c", " ", "<", ">",
        "http", "www", "1", "_", "É", "İ", "'t", "'", "ed", "̇", "À", "٣",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(5000)]
    texts += ["éon't go", "ÀN'T done", "İSTANBUL isn't", "a <b\ro> c", "http://x\xa0y", "www.a\x1cb c"]
    got = rows(spark, texts).select("t", X.expand_contractions("t"), X.clean_text("t")).collect()
    assert [(r[1], r[2]) for r in got] == [expected_clean(r.t) for r in got]


def test_strip_and_words_equal_python(spark):
    texts = ["\xa0 a b c \x1f", "　", "", "x", "\x85y\x0b", " ᠎ z", "a\x1cb"]
    got = rows(spark, texts).select("t", X.strip("t"), X.word_count("t"), X.is_blank("t")).collect()
    assert [tuple(r)[1:] for r in got] == [(t.strip(), len(t.split()), not t.strip()) for t in texts]


@pytest.mark.parametrize(
    "word,lemma",
    [
        ("running", "runn"), ("being", "being"), ("needed", "need"), ("need", "need"), ("boxes", "box"), ("does", "doe"),
        ("cats", "cat"), ("bus", "bus"), ("glass", "glass"), ("speeding", "speed"), ("things", "thing"), ("yes", "yes"),
    ],
)
def test_suffix_rule(spark, word, lemma):
    assert spark.range(1).select(X.lemmatize(F.array(F.lit(word)))[0]).first()[0] == lemma


def test_preprocess_joins_the_steps(spark):
    df = X.nlp_steps(rows(spark, [g[0] for g in GOLDEN if g[0]]), "t").withColumn("p", X.preprocess("t"))
    for r in df.collect():
        assert r.p == r.nlp_steps.processed_text == " ".join(r.nlp_steps.lemmatized_tokens)
        assert r.nlp_steps.num_tokens == len(r.nlp_steps.tokens)


def test_lemma_table_keeps_order_repeats_and_empty_rows(spark):
    df = spark.createDataFrame([(1, ["mice", "ran", "mice"]), (2, [])], "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse")], "token string, lemma string")
    got = {r.id: r.lemmas for r in X.lemmatize_with_table(df, "tokens", lemmas, "id").collect()}
    assert got == {1: ["mouse", "ran", "mouse"], 2: []}


@pytest.mark.parametrize(
    "text,accepted,message",
    [
        (None, False, "empty"),
        (" \xa0\n", False, "empty"),
        ("I am not feeling well", False, "designed"),
        ("Good   morning to everybody here", False, "designed"),
        ("This product made me sick.", True, "verified"),
        ("I love this", True, "verified"),
        ("it is not working", True, "verified"),
        ("productivity is up this week", True, "accepted"),
        ("hello there", False, "clearly"),
        ("hello hello hello there", False, "clearly"),
        ("went there and liked everything about it", True, "accepted"),
        ("élan is sickly sweet", True, "accepted"),
    ],
)
def test_gate(spark, text, accepted, message):
    g = rows(spark, [text]).select(domain_gate("t").alias("g")).first().g
    assert g.is_product_feedback is accepted
    assert message in g.message
    assert g.domain_status == (ACCEPTED if accepted else REJECTED)


def test_gate_message_of_empty_text(spark):
    assert rows(spark, [""]).select(domain_gate("t").message).first()[0] == EMPTY_MESSAGE
