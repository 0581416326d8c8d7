"""Train, validation and test splits without shared products.

A split is a cut in the order of ``md5(key:seed)``. The cut itself is an exact
order statistic, found without sorting all keys in one place: keys are counted
by the first two digits of their hashes, the running count names the one
beginning in which each cut falls, and only keys with such a beginning go on
to the next two digits. When few are left they are ranked. Rows are then
labelled by comparing their own hash with the cut, so the reviews are never
shuffled.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.schema import LABELS
from reviewloom.session import stage

SPLITS = ("train", "val", "test")

# Digits of a level: at most 16**2 counts per stratum leave a task. With every
# level a 256th of the members goes on; levels end when no more than RANKED are left.
LEVEL_DIGITS = 2
RANKED = 100_000


def hash_position(key, seed):
    """Place of a key in the order of a seed: its hash, then the key itself."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    seed = seed if not isinstance(seed, int) else F.lit(seed)
    return F.concat(F.md5(F.concat(text, F.lit(":"), seed.cast("string"))), text)


def rank_cuts(members: DataFrame, strata, quotas: DataFrame, position="position", digits=LEVEL_DIGITS, ranked=RANKED) -> DataFrame:
    """The position of the ``quota``-th member of each stratum, per cut.

    ``members``: strata columns and ``position``, which begins with random hex
    digits. ``quotas``: strata columns, ``cut`` and ``quota``, one row per cut:
    few rows, as are the strata. A cut with quota 0 or above the number of
    members has no row in the result. The members are read twice; what a level
    leaves is staged.
    """
    strata = list(strata)
    rows = members.select(*strata, F.col(position).alias("position"))
    # the beginning in which a cut falls, and which of its members is wanted
    edges = quotas.select(*strata, F.lit("").alias("beginning"), "cut", F.col("quota").alias("wanted"))
    width = 0
    while True:
        edges, rows = _next_level(rows, strata, edges, width, digits)
        width += digits
        # a position has 32 hash digits; members beyond that have equal hashes
        if width >= 32 or rows.count() <= ranked:
            break
    place = Window.partitionBy(*strata, "cut").orderBy("position")
    return (
        rows.withColumn("beginning", F.substring("position", 1, width))
        .join(F.broadcast(edges), strata + ["beginning"])
        .withColumn("_rank", F.row_number().over(place))
        .filter(F.col("_rank") == F.col("wanted"))
        .select(*strata, "cut", F.col("position").alias("cut_position"))
    )


def _next_level(rows, strata, edges, width, digits):
    """Edges with ``digits`` more, and the rows that have a beginning of one of them; both staged."""
    inner = [*strata, "beginning"]
    parts = rows.select(
        *strata, F.substring("position", 1, width).alias("beginning"), F.substring("position", width + 1, digits).alias("next")
    )
    running = Window.partitionBy(*inner).orderBy("next")
    sizes = (
        parts.groupBy(*inner, "next")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("upto", F.sum("size").over(running))
    )
    before = F.col("upto") - F.col("size")
    found = (
        sizes.join(F.broadcast(edges), inner)
        .filter((before < F.col("wanted")) & (F.col("wanted") <= F.col("upto")))
        .select(*strata, F.concat("beginning", "next").alias("beginning"), "cut", (F.col("wanted") - before).alias("wanted"))
    )
    found = stage(found, "cut-edges")
    left = rows.withColumn("beginning", F.substring("position", 1, width + digits)).join(
        F.broadcast(found.select(*inner).distinct()), inner, "left_semi"
    )
    return found, stage(left.drop("beginning"), "cut-members")


def _split_quotas(groups, train, val_of_rest):
    """Train: floor of its share of the groups; val: floor of its share of the rest."""
    n_train = F.floor(F.lit(float(train)) * groups)
    n_val = F.floor(F.lit(float(val_of_rest)) * (groups - n_train))
    return F.array(
        F.struct(F.lit("train").alias("cut"), n_train.cast("long").alias("quota")),
        F.struct(F.lit("val").alias("cut"), (n_train + n_val).cast("long").alias("quota")),
    )


def _split_name(position, train_cut, val_cut):
    # A missing train cut is an empty train split: nothing sorts up to "".
    return (
        F.when(position <= F.coalesce(train_cut, F.lit("")), SPLITS[0])
        .when(position <= F.coalesce(val_cut, train_cut, F.lit("")), SPLITS[1])
        .otherwise(SPLITS[2])
    )


def _seed_cuts(groups: DataFrame, key, seeds, train, val_of_rest) -> DataFrame:
    trials = groups.select(key, F.explode(F.lit(list(seeds))).alias("seed"))
    members = trials.select("seed", hash_position(key, F.col("seed")).alias("position"))
    # every seed deals out the same number of groups
    one = groups.agg(F.count(F.lit(1)).alias("groups")).filter("groups > 0")
    quotas = one.select("groups", F.explode(F.lit(list(seeds))).alias("seed")).select(
        "seed", F.inline(_split_quotas(F.col("groups"), train, val_of_rest))
    )
    cuts = rank_cuts(members, ["seed"], quotas)
    return cuts.groupBy("seed").agg(
        *[F.max(F.when(F.col("cut") == c, F.col("cut_position"))).alias(f"{c}_cut") for c in ("train", "val")]
    )


def group_split(reviews: DataFrame, key="product_id", seed=42, train=0.70, val_of_rest=0.50) -> DataFrame:
    """Add ``split``: all rows of a key in the same one, shares counted in keys.

    The two cut positions are the only data that pass the driver.
    """
    cuts = _seed_cuts(reviews.select(key).distinct(), key, [seed], train, val_of_rest).first()
    position = hash_position(key, seed)
    train_cut, val_cut = (cuts.train_cut, cuts.val_cut) if cuts else (None, None)
    return reviews.withColumn("split", _split_name(position, _text(train_cut), _text(val_cut)))


def _text(value):
    return F.lit(value).cast("string")


def seed_scores(
    reviews: DataFrame, key="product_id", label="sentiment", seeds=range(42, 142), train=0.70, val_of_rest=0.50
) -> DataFrame:
    """Class divergence of the group split of every seed, in one job.

    Divergence: the absolute difference of class shares from the whole table,
    summed over splits and classes. The reviews are read once, here; all seeds
    work on the staged class counts per key.
    """
    counts = stage(
        reviews.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in LABELS]
        ),
        "class-counts",
    )
    cuts = _seed_cuts(counts, key, seeds, train, val_of_rest)
    sums = [F.sum(c).alias(c) for c in ["n", *[f"n_{c}" for c in LABELS]]]
    per_split = (
        counts.withColumn("seed", F.explode(F.lit(list(seeds))))
        .join(F.broadcast(cuts), "seed", "left")
        .withColumn("split", _split_name(hash_position(key, F.col("seed")), F.col("train_cut"), F.col("val_cut")))
        .groupBy("seed", "split")
        .agg(*sums, F.first("train_cut").alias("train_cut"), F.first("val_cut").alias("val_cut"))
    )
    # The three splits of a seed together are the population.
    whole = Window.partitionBy("seed")
    gaps = sum(
        F.abs(F.col(f"n_{c}") / F.col("n") - F.sum(f"n_{c}").over(whole) / F.sum("n").over(whole)) for c in LABELS
    )
    # An empty split has no class shares: each counts as 0.
    missing = sum(F.sum(f"n_{c}") for c in LABELS) / F.sum("n") * (3 - F.count(F.lit(1)))
    return (
        per_split.withColumn("gap", gaps)
        .groupBy("seed")
        .agg(
            (F.sum("gap") + missing).alias("divergence"),
            F.first("train_cut").alias("train_cut"),
            F.first("val_cut").alias("val_cut"),
        )
    )


def best_group_split(reviews: DataFrame, key="product_id", label="sentiment", seeds=range(42, 142), **shares):
    """The split with the smallest divergence (earliest seed on ties).

    Returns the labelled reviews, the seed and its divergence.
    """
    scores = seed_scores(reviews, key, label, seeds, **shares)
    best = scores.orderBy(F.round("divergence", 12), "seed").first()
    if best is None:
        raise ValueError("no reviews to split")
    position = hash_position(key, best.seed)
    split = _split_name(position, _text(best.train_cut), _text(best.val_cut))
    return reviews.withColumn("split", split), best.seed, best.divergence


def split_leakage(split_reviews: DataFrame, key="product_id") -> DataFrame:
    """Keys that each pair of splits shares; all zero in a sound split. Another split name is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce("split", F.lit("NULL")))).cast("int")
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2)
    bit = bit.when(F.col("split") == "test", 4).otherwise(unknown)
    masks = split_reviews.groupBy(key).agg(F.bit_or(bit).alias("mask"))
    return masks.agg(
        F.count_if(F.col("mask").bitwiseAND(3) == 3).alias("train_val"),
        F.count_if(F.col("mask").bitwiseAND(5) == 5).alias("train_test"),
        F.count_if(F.col("mask").bitwiseAND(6) == 6).alias("val_test"),
    )


def assert_no_leakage(split_reviews: DataFrame, key="product_id") -> DataFrame:
    shared = split_leakage(split_reviews, key).first().asDict()
    if any(shared.values()):
        raise ValueError(f"splits share values of {key}: {shared}")
    return split_reviews


def split_report(split_reviews: DataFrame, key="product_id", label="sentiment") -> DataFrame:
    """Rows, share, distinct keys and classes of each split and of the population."""
    counts = split_reviews.groupBy("split", key).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in LABELS]
    )
    rows = counts.rollup("split").agg(
        F.sum("n").alias("n_rows"),
        F.count_distinct(F.coalesce(F.col(key), F.lit(""))).alias("n_keys"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in LABELS],
    )
    total = F.max("n_rows").over(Window.partitionBy())  # of four rows: the population's
    return rows.select(
        F.coalesce("split", F.lit("population")).alias("split"),
        "n_rows",
        (F.col("n_rows") * 100.0 / total).alias("percent_rows"),
        "n_keys",
        *[f"n_{c}" for c in LABELS],
        *[(F.col(f"n_{c}") * 100.0 / F.col("n_rows")).alias(f"percent_{c}") for c in LABELS],
    )


def _class_quotas(counts: DataFrame, label, test_fraction) -> DataFrame:
    """Train rows per class: shares of the train size, largest remainders first."""
    n = F.sum("n").over(Window.partitionBy())
    share = F.col("n") * F.col("n_train") / F.col("total")
    by_remainder = Window.partitionBy().orderBy(F.desc(F.round(share - F.floor(share), 9)), label)
    return (
        counts.withColumn("total", n)
        .withColumn("n_train", F.col("total") - F.ceil(F.lit(float(test_fraction)) * F.col("total")))
        .withColumn("base", F.floor(share))
        .withColumn("left", F.col("n_train") - F.sum("base").over(Window.partitionBy()))
        .withColumn("order", F.row_number().over(by_remainder))
        .select(
            label,
            F.lit("train").alias("cut"),
            (F.col("base") + F.when(F.col("order") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"),
        )
    )


def _within_cut(reviews, keys, label, key, seed, quotas):
    """Rows of ``reviews`` with the flag ``_in``: among the quota of their class, by the staged ``keys``."""
    members = keys.select(label, hash_position(key, seed).alias("position"))
    cuts = rank_cuts(members, [label], quotas).select(label, "cut_position")
    flag = F.coalesce(hash_position(key, seed) <= F.col("cut_position"), F.lit(False))
    return reviews.join(F.broadcast(cuts), label, "left").withColumn("_in", flag).drop("cut_position")


def stratified_split(reviews: DataFrame, label="sentiment", test_fraction=0.2, key="review_id", seed=42) -> DataFrame:
    """Add ``split`` (train, test) with the same class shares on both sides.

    ``key`` identifies a row. Labels are few; their quotas are one row each.
    The reviews are read twice: for their keys, and to be labelled.
    """
    keys = stage(reviews.select(label, key), "keys")
    counts = keys.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    flagged = _within_cut(reviews, keys, label, key, seed, _class_quotas(counts, label, test_fraction))
    return flagged.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def sample_per_class(reviews: DataFrame, n: int, label="sentiment", key="review_id", seed=42) -> DataFrame:
    """``n`` rows of each class (all of a smaller class), drawn by hash order."""
    keys = stage(reviews.select(label, key), "keys")
    quotas = (
        keys.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("quota"))
        .withColumn("cut", F.lit("sample"))
    )
    return _within_cut(reviews, keys, label, key, seed, quotas).filter("_in").drop("_in")


def with_split(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("split", F.lit(name))


def union_splits(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack split tables by column name."""
    for df in others:
        first = first.unionByName(df)
    return first
