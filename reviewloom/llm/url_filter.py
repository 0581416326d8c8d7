"""URL rules that run only where a rare literal token of theirs occurs.

Every rule is a regular expression over ``host + path`` with the literal
tokens that any match must contain. Each rule is indexed by the one of its
tokens that is rarest among the addresses at hand. The tokens of an address
fetch candidate rules by an equi-join, and only those run their expression.
"""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import ascii_lower
from reviewloom.session import stage

NOT_TOKEN = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; among the fitting rules the higher ``rank``, then the longer name wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def address_rule(verdict, host, path) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    text = host + path
    tokens = re.findall(r"(?<![0-9A-Za-z])[0-9A-Za-z]+(?![0-9A-Za-z])", text)
    if tokens and text.endswith(tokens[-1]):
        tokens.pop()  # the url may go on with letters
    if not tokens:
        raise ValueError(f"rule {text!r} has no whole literal token")
    pattern = r"^(?:[^/]*\.)?" + re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)
    return Rule(text, verdict, pattern, tuple(sorted({t.lower() for t in tokens})), rank=1)


#: Rules on addresses; the longest that fits decides.
ADDRESS_RULES = (
    address_rule("block", "net", "/"),
    address_rule("allow", "example.net", "/en/"),
    address_rule("block", "example.com", "/de/"),
    address_rule("allow", "org", "/fr/"),
)

#: Patterns that decide where no address rule fits: names of spam trades in the host.
PATTERN_RULES = (
    Rule("casino", "block", r"^[^/]*(?<![0-9A-Za-z])casino(?![0-9A-Za-z])[^/]*(?:/|$)", ("casino",)),
    Rule("free bets", "block", r"^[^/]*(?<![0-9A-Za-z])free-bets(?![0-9A-Za-z])[^/]*(?:/|$)", ("free", "bets")),
    Rule("cheap pills", "block", r"^[^/]*(?<![0-9A-Za-z])cheap-pills(?![0-9A-Za-z])[^/]*(?:/|$)", ("cheap", "pills")),
)


def host_and_path(url):
    """Host (A-Z in lower case) and path of a url; both empty without ``://`` or url."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def rules_table(spark: SparkSession, rules) -> DataFrame:
    """The rules as rows; their size is known to the planner, which alone decides on a broadcast."""
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r.name).alias("name"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.pattern).alias("pattern"),
            F.lit(r.rank).alias("rank"),
            F.array(*[F.lit(t) for t in r.tokens]).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rarest_tokens(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """The rules with the one of their tokens that the fewest ``addresses`` contain."""
    tokens = rules.select("rule_no", F.explode("tokens").alias("token"))
    seen = addresses.select(F.explode("tokens").alias("token"))
    counts = seen.join(tokens.select("token").distinct(), "token").groupBy("token").count()
    chosen = (
        tokens.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token")).alias("rarest"))
        .select("rule_no", F.col("rarest.token").alias("token"))
    )
    return rules.drop("tokens").join(chosen, "rule_no")


def judge_urls(pages: DataFrame, rules=ADDRESS_RULES + PATTERN_RULES, otherwise="allow", key="page_id") -> DataFrame:
    """``key``, host, path, rule, verdict and pattern per row of ``pages``.

    ``rule`` is the address rule that decided, ``pattern`` the name of the
    pattern that did where no address rule fits; without either the verdict is
    ``otherwise``. Each distinct url is judged once, so a url on a third of
    the rows costs one row. A url that is NULL or has no ``://`` has an empty
    host and path, and no rule fits. Repeated rows are judged each; an empty
    table gives no row; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    words = F.split(F.lower(F.concat("host", "path")), NOT_TOKEN)
    addresses = stage(urls.withColumn("tokens", F.array_distinct(words)), "addresses")
    index = rarest_tokens(rules_table(spark, rules), addresses)
    found = (
        addresses.select("url", F.concat("host", "path").alias("address"), F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.expr("address rlike pattern"))
        .groupBy("url")
        .agg(F.max(F.struct("rank", F.length("name").alias("size"), "name", "verdict")).alias("best"))
        .withColumnRenamed("url", "found_url")
    )
    judged = addresses.join(found, F.col("url") == F.col("found_url"), "left").select(
        F.col("url").alias("judged_url"),
        "host",
        "path",
        F.when(F.col("best.rank") > 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
        F.when(F.col("best.rank") == 0, F.col("best.name")).alias("pattern"),
    )
    rows = pages.select(key, "url")
    return rows.join(judged, F.col("url").eqNullSafe(F.col("judged_url")), "left").drop("url", "judged_url")
