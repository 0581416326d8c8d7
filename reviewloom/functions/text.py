"""Text rules as column expressions.

The patterns use Unicode classes, and ``\\n`` is the only line end (``(?d)``).
Whitespace also counts the control characters U+001C to U+001F, and a word
character is a letter, a number or ``_``: the classes of Java differ in both.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1C-\x1F]"
NON_SPACE = r"[^\s\x1C-\x1F]"
WORD_CHAR = r"[\p{L}\p{N}_]"

# The English stop words, contractions included.
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be
    because been before being below between both but by can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for
    from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've
    if in into is isn't it it's its itself let let's me more most mustn't my
    myself no nor not of off on once only or other ought our ours ourselves out
    over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these
    they they'd they'll they're they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were weren't what what's when
    when's where where's which while who who's whom why why's with won't would
    wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)

# Negations, kept although they are stop words.
NEGATION_WORDS = tuple(
    """
    no nor not never none neither cannot cant dont isnt didnt wasnt wouldnt
    shouldnt couldnt hasnt havent hadnt without can't don't isn't didn't wasn't
    wouldn't shouldn't couldn't hasn't haven't hadn't
    """.split()
)

DROPPED_WORDS = tuple(w for w in STOP_WORDS if w not in NEGATION_WORDS)

# One suffix per word: -ing from 6 letters, -ed and -es from 5, a lone -s from 4.
_SUFFIX = r"\b(?:([a-z]{3,})ing|([a-z]{3,})ed|([a-z]{3,})es|([a-z]{2,}[a-rt-z])s)\b"
_SUFFIX_KEPT = "$1$2$3$4"


def _col(c):
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    return strip(c) == ""


def word_count(c) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(_col(c), F.lit(f"(?U){NON_SPACE}+")).cast("long")


def normalize_join_text(c) -> Column:
    """Match key of a text: stripped, in lower case."""
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def text_digest(c) -> Column:
    """SHA-256 of a text as 32 bytes: the grouping key in place of the text.

    Equal texts, and in practice only those, have equal digests, so shuffles
    carry 32 bytes per row whatever the length of the text. NULL stays NULL.
    """
    return F.unhex(F.sha2(_col(c), 256))


def expand_contractions(c) -> Column:
    """Lower case, with negative contractions spelled out.

    The patterns start with a letter and look back for the word boundary: that
    is cheaper than trying a boundary at every character. Texts without
    ``n't`` skip them.
    """
    lower = F.lower(F.coalesce(_col(c), F.lit("")))
    end = f"['’]t(?!{WORD_CHAR})"
    t = F.regexp_replace(lower, f"can(?<!{WORD_CHAR}can){end}", "cannot")
    t = F.regexp_replace(t, f"won(?<!{WORD_CHAR}won){end}", "will not")
    t = F.regexp_replace(t, f"shan(?<!{WORD_CHAR}shan){end}", "shall not")
    t = F.regexp_replace(t, f"n(?<={WORD_CHAR}n){end}", " not")
    return F.when(lower.contains("n't") | lower.contains("n’t"), t).otherwise(lower)


def clean_text(c) -> Column:
    """Words of two or more ASCII letters, one space between them.

    In this order: contractions, tags, addresses, then every other character
    and every lone letter are dropped.
    """
    t = expand_contractions(c)
    t = F.regexp_replace(t, r"(?d)<.*?>", " ")
    t = F.regexp_replace(t, rf"(?U)(?:http|www){NON_SPACE}+", " ")
    t = F.regexp_replace(t, "[^a-z]+", " ")
    return F.trim(F.regexp_replace(t, r"\b[a-z]\b ?", ""))


def tokenize(c) -> Column:
    """The words of the cleaned text, in order."""
    return F.regexp_extract_all(clean_text(c), F.lit("[a-z]{2,}"), F.lit(0))


def remove_stopwords(tokens) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.isin(*DROPPED_WORDS) & (F.length(t) > 1))


def lemmatize(tokens) -> Column:
    """Strip one inflection suffix from each token."""
    return F.transform(_col(tokens), lambda t: F.regexp_replace(t, _SUFFIX, _SUFFIX_KEPT))


#: Maps at most that hold the changes of a row.
_SLOTS = 64


def lemmatize_with_table(df, tokens, lemmas, id_col, out="lemmas"):
    """Replace tokens by the lemma a table gives (``token``, ``lemma``).

    Tokens the table does not list stay as they are; of several lemmas of a
    token the first by name counts. Each row sends the distinct tokens of its
    own to the table, and only those that change come back, as maps that are
    applied in place: token lists are not taken apart. A token of every row is
    joined by adaptive execution in several tasks, or to a broadcast table.
    Rows meet by a hash of ``id_col`` and their tokens, so a repeated id does
    no harm; rows of one hash share a map of the tokens of both. Rows without
    tokens get an empty list.
    """
    own = F.coalesce(_col(tokens), F.array().cast("array<string>"))
    keyed = df.withColumn("_own", own).withColumn("_row", F.xxhash64(F.col(id_col), F.col("_own")))
    one = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")).filter("lemma <> token")
    words = keyed.select("_row", F.explode(F.array_distinct("_own")).alias("token"))
    listed = words.join(one, "token").withColumn("hash", F.xxhash64("token")).groupBy("_row")
    listed = listed.agg(F.collect_set(F.struct("hash", "token", "lemma")).alias("_list"))
    # a map is searched from its beginning: many changes are dealt to several
    slots = F.least(F.lit(_SLOTS), F.ceil(F.size("_list") / 4)).cast("long")

    def changed(slot):
        entries = F.filter("_list", lambda e: F.pmod(e["hash"], slots) == slot)
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["token"], e["lemma"])))

    changes = listed.select("_row", F.transform(F.sequence(F.lit(0).cast("long"), slots - 1), changed).alias("_changes"))
    slot = lambda t: F.pmod(F.xxhash64(t), F.size("_changes")).cast("int") + 1
    replaced = F.transform("_own", lambda t: F.coalesce(F.element_at(F.element_at("_changes", slot(t)), t), t))
    return (
        keyed.join(changes, "_row", "left")
        .withColumn(out, F.when(F.col("_changes").isNull(), F.col("_own")).otherwise(replaced))
        .drop("_row", "_own", "_changes")
    )


def preprocess(c) -> Column:
    """Clean, drop stop words, strip suffixes, join by spaces."""
    return F.array_join(lemmatize(remove_stopwords(tokenize(c))), " ")


def nlp_steps(df, text, out="nlp_steps"):
    """Every intermediate result of the text rules, as one struct per review."""
    return (
        df.withColumn("_cleaned", clean_text(text))
        .withColumn("_tokens", F.regexp_extract_all("_cleaned", F.lit("[a-z]{2,}"), F.lit(0)))
        .withColumn("_filtered", remove_stopwords("_tokens"))
        .withColumn("_lemmas", lemmatize("_filtered"))
        .withColumn(
            out,
            F.struct(
                F.col(text).alias("original_text"),
                F.col("_cleaned").alias("cleaned_text"),
                F.col("_tokens").alias("tokens"),
                F.col("_filtered").alias("filtered_tokens"),
                F.col("_lemmas").alias("lemmatized_tokens"),
                F.array_join("_lemmas", " ").alias("processed_text"),
                F.size("_tokens").cast("long").alias("num_tokens"),
            ),
        )
        .drop("_cleaned", "_tokens", "_filtered", "_lemmas")
    )
