"""Exact duplicates with the frequent texts split off.

A text that fills a third of the corpus would send a third of all rows to one
task. Misra-Gries counters (``freqItems``) find every digest above a share of
the rows, possibly with false ones; exact counts verify them. The verified
winners, at most ``1 / support`` rows, are broadcast, so their copies are
settled where they are read. All other digests are shuffled as usual.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import in_order, whole_rows
from reviewloom.session import stage

WHITESPACE = r"[\x20\x09-\x0D]"
#: Share of the rows above which a digest counts as frequent.
SUPPORT = 0.005


def normalized(column="text"):
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), WHITESPACE, "")


def text_digest(column="text"):
    return F.sha2(normalized(column).cast("binary"), 256)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the normalised text and the code points of the text as it is."""
    points = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select("doc_id", text_digest().alias("text_sha256"), points.alias("n_points"))


def _groups(digests):
    """One row per digest: the row that stays and the number of copies."""
    best = F.struct((-F.col("n_points")).alias("shorter"), in_order("doc_id").alias("id"))
    return (
        digests.groupBy("text_sha256")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "text_sha256",
            "group_size",
            F.col("best.id.value").alias("keep_id"),
            (-F.col("best.shorter")).alias("keep_points"),
        )
    )


def frequent_digests(digests: DataFrame, support=SUPPORT) -> DataFrame:
    """The digests that hold at least ``support`` of the rows: at most ``1 / support`` groups.

    The counters may name digests that are less frequent, so the candidates
    are counted exactly; only one pass over rows that match them.
    """
    found = digests.stat.freqItems(["text_sha256"], support)
    candidates = found.select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    least = max(2, support * digests.count())
    return _groups(digests.join(F.broadcast(candidates), "text_sha256")).filter(F.col("group_size") >= least)


def exact_duplicates(docs: DataFrame, support=SUPPORT) -> DataFrame:
    """One row per row of ``docs``, with the row of its group that stays.

    Texts are equal when they are identical without white space. The row with
    the most code points stays, then the smallest ``doc_id``; a row without
    ``doc_id`` comes last. Rows repeated under one ``doc_id`` with texts of one
    length are one document: all of them are marked as kept. NULL counts as
    empty text, all empty texts are one group, and an empty table gives no row.
    Other columns of ``docs`` are not read.
    """
    digests = stage(text_digests(docs), "digests")
    winners = stage(frequent_digests(digests, support), "frequent")
    hot = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    settled = hot.unionByName(rest.join(_groups(rest), "text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return settled.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_points")


def drop_exact_duplicates(docs: DataFrame, support=SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, all columns.

    The copies of frequent texts go before the shuffle, where they are read.
    """
    decisions = stage(exact_duplicates(docs, support), "exact")
    least = max(2, support * decisions.count())
    keys = ["doc_id", "text_sha256", "n_points"]
    frequent = decisions.filter((F.col("group_size") >= least) & F.col("kept"))
    frequent = frequent.select(
        F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("n_points").alias("_most")
    ).distinct()
    dropped = decisions.filter(~F.col("kept") & (F.col("group_size") < least)).select(*keys)
    repeated = decisions.filter("kept").groupBy(*keys).count().filter("count > 1").select(*keys)

    marked = whole_rows(docs).select(
        F.col("row").alias("_row"),
        text_digest("row.text").alias("_sha"),
        F.length(F.coalesce(F.col("row.text"), F.lit(""))).cast("long").alias("_n"),
    )
    ahead = marked.join(F.broadcast(frequent), F.col("_sha") == F.col("_digest"), "left")
    stays = F.col("_digest").isNull() | (
        F.col("_row.doc_id").eqNullSafe(F.col("_keep")) & (F.col("_n") == F.col("_most"))
    )
    ahead = ahead.filter(stays).select("_row", "_sha", "_n")

    def same(other):
        return (
            (F.col("_sha") == other["text_sha256"])
            & (F.col("_n") == other["n_points"])
            & F.col("_row.doc_id").eqNullSafe(other["doc_id"])
        )

    left = ahead.join(dropped, same(dropped), "left_anti")
    repeated = stage(repeated, "repeated")
    if not repeated.isEmpty():  # one row each of those that occur more than once
        single = left.join(repeated, same(repeated), "left_anti")
        several = left.join(repeated, same(repeated), "left_semi")
        first = several.groupBy("_sha", "_n", F.col("_row.doc_id").alias("_id")).agg(F.first("_row").alias("_row"))
        left = single.unionByName(first.select("_row", "_sha", "_n"))
    return left.select("_row.*")
