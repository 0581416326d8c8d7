"""Data quality of a review table.

All operators are aggregations with a partial step before the shuffle, so a
value that fills a third of the table reaches the shuffle as one row per task.
Repeats are counted on 32-byte digests, never on the texts. Medians and
quantiles come from a histogram that is grouped in parallel, so no task merges
more than the distinct values.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.labels import star_sentiment, valid_stars
from reviewloom.functions.text import is_blank, text_digest, word_count
from reviewloom.schema import INVALID, LABELS, STARS
from reviewloom.session import stage


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def _profile(df, measure, name):
    """One aggregation over the table, one output row per column."""
    fields = [f for f in df.schema if measure(f) is not None]
    sums = df.agg(*[F.count_if(measure(f)).alias(f.name) for f in fields])
    rows = F.array(
        *[F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").alias(name)) for f in fields]
    )
    return sums.select(F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    return _profile(df, lambda f: F.col(f"`{f.name}`").isNull(), "n_null")


def _blank(field):
    return is_blank(F.col(f"`{field.name}`")) if isinstance(field.dataType, T.StringType) else None


def blank_counts(df: DataFrame) -> DataFrame:
    """Per text column: values that are empty or only whitespace; NULL is neither."""
    return _profile(df, _blank, "n_blank")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, NULLs and blanks of each column, in one pass."""
    sums, rows = [], []
    for i, field in enumerate(df.schema):
        blank = _blank(field)
        sums.append(F.count_if(F.col(f"`{field.name}`").isNull()).alias(f"null_{i}"))
        sums.append(F.count_if(F.lit(False) if blank is None else blank).alias(f"blank_{i}"))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.col(f"null_{i}").alias("n_null"),
                (F.lit(None).cast("long") if blank is None else F.col(f"blank_{i}")).alias("n_blank"),
            )
        )
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def invalid_star_count(df: DataFrame, stars="stars") -> DataFrame:
    return df.agg(F.count_if(~valid_stars(stars)).alias("n_invalid_stars"))


def value_counts(df: DataFrame, column: str, by_value=False) -> DataFrame:
    """Rows per value, NULL left out; most frequent first, or by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(column) if by_value else counts.orderBy(F.desc("n"), column)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their percentage of all rows with a value."""
    return _with_percent(value_counts(df, column)).orderBy(F.desc("n"), column)


def _with_percent(counts):
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def distinct_counts(
    df: DataFrame, columns=("review_id", "product_id", "reviewer_id"), approximate=False
) -> DataFrame:
    """Distinct non-NULL values per column, one row; exact unless told otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"distinct_{c}") for c in columns])


def row_digest(columns):
    """SHA-256 of a whole row; NULL differs from every value."""
    parts = []
    for c in columns:
        value = F.col(f"`{c}`").cast("string")
        parts += [F.coalesce(F.octet_length(value).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(value, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _repeats(df, digests):
    """Rows that repeat an earlier digest, one column per named digest.

    All digests are counted in one shuffle. A NULL digest repeats nothing.
    """
    rows = F.array(*[F.struct(F.lit(name).alias("_name"), d.alias("_digest")) for name, d in digests.items()])
    digested = df.select(F.inline(rows)).filter(F.col("_digest").isNotNull())
    groups = digested.groupBy("_name", "_digest").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_name") == name, F.col("n") - 1)), F.lit(0)).alias(name)
            for name in digests
        ]
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier complete row; NULLs are equal."""
    return _repeats(df, {"n_duplicate_rows": row_digest(df.columns)})


def duplicate_values(df: DataFrame, column: str, drop_null=False) -> DataFrame:
    """How many rows repeat an earlier value; NULL is one value or left out."""
    return _repeats(df, {"n_duplicates": text_digest(column) if drop_null else _value_digest(column)})


def _value_digest(column):
    """The digest of a text; NULL gets one of its own."""
    return F.coalesce(text_digest(column), F.unhex(F.lit("00")))


def histogram_stats(histogram: DataFrame, by: str, value="value", n="n") -> DataFrame:
    """Mean, sample deviation, extremes and quartiles of a (by, value, n) histogram.

    The squares are summed as exact integers, so the deviation does not lose
    digits on large tables.
    """
    v, c = F.col(value), F.col(n)
    exact = "decimal(38,0)"
    total, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
    variance = (total * s2 - s1 * s1).cast("double") / (total.cast("double") * (total.cast("double") - 1))
    return (
        histogram.groupBy(by)
        .agg(
            F.sum(c).cast(exact).alias("_n"),
            F.sum((v * c).cast(exact)).cast(exact).alias("_s1"),
            F.sum((v * v).cast(exact) * c.cast("decimal(18,0)")).cast(exact).alias("_s2"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), c).alias("_q"),
        )
        .select(
            by,
            total.cast("long").alias("n"),
            (s1.cast("double") / total.cast("double")).alias("mean"),
            F.when(total > 1, F.sqrt(variance)).alias("std"),
            "min",
            "max",
            F.col("_q")[1].alias("median"),
            F.col("_q")[0].alias("q25"),
            F.col("_q")[2].alias("q75"),
        )
    )


def group_size_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the rows per value of each key, one row per key.

    ``n_groups`` is the number of distinct values. NULL is no value.
    """
    values = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("_id")) for k in keys])
    sizes = (
        df.select(F.inline(values))
        .filter(F.col("_id").isNotNull())
        .groupBy("key", "_id")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    histogram = sizes.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return histogram_stats(histogram, "key").withColumnRenamed("n", "n_groups")


def length_stats(df: DataFrame, columns=("review_body", "review_title")) -> DataFrame:
    """Statistics of the characters and words per text; NULL counts as empty."""
    measures = []
    for column in columns:
        text = F.coalesce(F.col(column), F.lit(""))
        for unit, size in (("chars", F.length(text).cast("long")), ("words", word_count(text))):
            measures.append(F.struct(F.lit(f"{column}_{unit}").alias("measure"), size.alias("value")))
    histogram = (
        df.select(F.inline(F.array(*measures))).groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return histogram_stats(histogram, "measure")


def crosstab(df: DataFrame, row: str, column, values, prefix="") -> DataFrame:
    """Rows per pair; one column per value of a fixed list, 0 where no row is."""
    c = F.col(column) if isinstance(column, str) else column
    sums = [F.count_if(c == v).alias(f"{prefix}{v}") for v in values]
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*sums)


def category_by_sentiment(df: DataFrame, category="product_category", stars="stars") -> DataFrame:
    return crosstab(df, category, star_sentiment(stars), LABELS + (INVALID,))


def category_by_stars(df: DataFrame, category="product_category", stars="stars") -> DataFrame:
    return crosstab(df, category, stars, STARS, prefix="stars_")


def _entry(section, key, value):
    """One line of the audit: its section, the key in it, and the value as text."""
    return F.struct(
        F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"),
        (F.lit(key) if isinstance(key, str) else key).cast("string").alias("key"),
        value.cast("string").alias("value"),
    )


STATISTICS = ("mean", "std", "min", "max", "median", "q25", "q75")


def audit_entries(df: DataFrame) -> DataFrame:
    """The whole audit in long form (section, key, value); numbers with a fraction have six digits.

    The table is read three times: once for the counts of NULLs, blanks and
    cells of (category, stars, language) and the lengths, once for the ids and
    once for the digests. The first read is one grouping whose rows are the
    cells and the distinct lengths, staged; all distributions, crosstabs and
    statistics follow from it.
    """
    columns = list(enumerate(df.columns))
    texts = [(i, f.name) for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    measures = []
    for column in ("review_body", "review_title"):
        text = F.coalesce(F.col(column), F.lit(""))
        measures.append(F.struct(F.lit(f"{column}_chars").alias("measure"), F.length(text).cast("long").alias("size")))
        measures.append(F.struct(F.lit(f"{column}_words").alias("measure"), word_count(text).alias("size")))
    cell = F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("long").alias("size"))
    first = F.col("measure").isNull()  # the line that stands for the row itself
    read = df.select("*", F.inline(F.array(cell, *measures)))
    keys = ["measure", "size"] + [F.when(first, F.col(c)).alias(c) for c in ("product_category", "stars", "language")]
    cells = read.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(first & ~valid_stars("stars")).alias("invalid_stars"),
        *[F.count_if(first & F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in columns],
        *[F.count_if(first & is_blank(F.col(f"`{c}`"))).alias(f"blank_{i}") for i, c in texts],
    )
    cells = stage(cells, "audit-cells")
    whole = cells.filter("measure IS NULL").withColumn("sentiment", star_sentiment("stars"))

    facts = whole.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells.columns if c.startswith(("null_", "blank_", "invalid_"))],
    )
    lines = [
        _entry("shape", "n_rows", F.col("n_rows")),
        _entry("shape", "n_columns", F.lit(len(columns))),
        *[_entry("column_types", c, F.lit(t)) for c, t in df.dtypes],
        *[_entry("missing_values", c, F.col(f"null_{i}")) for i, c in columns],
        *[_entry("empty_strings", c, F.col(f"blank_{i}")) for i, c in texts],
        _entry("invalid_stars", "invalid_stars", F.col("invalid_stars")),
    ]
    repeats = _repeats(
        df,
        {
            "complete_rows": row_digest(df.columns),
            "review_bodies": _value_digest("review_body"),
            "review_titles": text_digest("review_title"),
        },
    )
    ids = group_size_stats(df, "review_id", "product_id", "reviewer_id")
    sizes = histogram_stats(cells.filter("measure IS NOT NULL"), "measure", "size")

    def number(column):
        return F.when(F.col(column).isNotNull(), F.format_string("%.6f", F.col(column).cast("double")))

    def statistics(section, key):
        return [_entry(section, F.concat(F.col(key), F.lit("."), F.lit(s)), number(s)) for s in STATISTICS]

    names = {
        "language": "language_distribution",
        "product_category": "category_distribution",
        "stars": "star_distribution",
        "sentiment": "sentiment_distribution",
    }
    keyed = [_entry(section, F.col(column), F.lit(None)) for column, section in names.items()]
    for column, section in (("sentiment", "category_by_sentiment"), ("stars", "category_by_stars")):
        pair = F.concat(F.col("product_category"), F.lit("."), F.col(column).cast("string"))
        keyed.append(_entry(section, pair, F.lit(None)))
    counts = whole.select("n", F.inline(F.array(*keyed))).filter(F.col("key").isNotNull())
    counts = counts.groupBy("section", "key").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("section"))
    counts = counts.withColumn("percent", F.col("n") * 100.0 / total)
    distributions = F.filter(
        F.array(
            _entry(F.col("section"), F.col("key"), F.col("n")),
            F.when(
                F.col("section") == names["sentiment"], _entry("sentiment_percent", F.col("key"), number("percent"))
            ),
        ),
        lambda line: line.isNotNull(),
    )
    parts = [
        facts.select(F.inline(F.array(*lines))),
        repeats.select(F.inline(F.array(*[_entry("duplicates", c, F.col(c)) for c in repeats.columns]))),
        ids.select(
            F.inline(F.array(_entry("distinct_ids", F.col("key"), F.col("n_groups")), *statistics("reviews_per_id", "key")))
        ),
        sizes.select(F.inline(F.array(*statistics("text_lengths", "measure")))),
        counts.select(F.inline(distributions)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull())


def _quoted(text):
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _members(of, name, value):
    """JSON members in the order of their names; a section has one for each column, category or language."""
    pairs = F.array_sort(F.collect_list(F.struct(name.alias("name"), value.alias("value"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["name"]), F.lit(":"), p["value"])), ",")
    return of.agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("json"))


NESTED = ("reviews_per_id", "text_lengths", "category_by_sentiment", "category_by_stars")


def audit_report(df: DataFrame) -> DataFrame:
    """The whole audit as one JSON document in the column ``report``."""
    nested = F.col("section").isin(*NESTED)
    split = r"(?s)^(.*)\.([^.]*)$"
    entries = audit_entries(df).select(
        "section",
        F.when(nested, F.regexp_extract("key", split, 1)).alias("outer"),
        F.when(nested, F.regexp_extract("key", split, 2)).otherwise(F.col("key")).alias("name"),
        F.when(F.col("section") == "column_types", _quoted(F.col("value"))).otherwise(F.col("value")).alias("value"),
    )
    inner = _members(entries.filter("outer IS NOT NULL").groupBy("section", "outer"), F.col("name"), F.col("value"))
    flat = entries.filter("outer IS NULL").select("section", "name", "value")
    flat = flat.unionByName(inner.select("section", F.col("outer").alias("name"), F.col("json").alias("value")))
    sections = _members(flat.groupBy("section"), F.col("name"), F.col("value"))
    return _members(sections.groupBy(), F.col("section"), F.col("json")).withColumnRenamed("json", "report")
