"""Connected components by alternating large-star and small-star."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import stage


def _large_star(edges):
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges):
    """Every neighbour below a node, and the node itself, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    below = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _is_star(edges):
    """Whether every link (u, v) is the only one of its u, and no v has a link of its own."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("centre")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("centre")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
    return nodes.filter("links + centre > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node that can be reached.

    Ends when every component is a star around its smallest node, after a
    number of rounds that grows with the logarithm of the longest path. Each
    round is a written table, so lost executors repeat one round at most. A
    node with very many links is one minimum per task before the shuffle; the
    join gives its partition to several tasks (``spark.sql.adaptive.skewJoin``).
    Loops and repeated links are ignored; no links give no rows.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    while not _is_star(edges):
        edges = stage(_small_star(_large_star(edges)), "stars")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
