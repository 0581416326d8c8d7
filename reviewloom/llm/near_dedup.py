"""Near duplicates by MinHash, exact set comparison and connected components.

Equal shingle sets are one class with one representative, however many copies
there are. Minima of many universal hashes are banded into buckets. Pairs of a
bucket are not written out: first each representative is compared with the
smallest member of the bucket that it shares the most bands with, which joins
whole groups of near copies in as many comparisons as there are members. Only
members of one bucket that are still in different components meet in blocks:
there the signatures of each pair are compared in the first bucket that it
shares, and where they agree the full sets, until a link has joined the two
components. A link between documents that are already joined could not change
a component, so none is lost that the bands find, and no list of pairs is
written.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8, whole_rows
from reviewloom.llm.components import connected_components
from reviewloom.llm.shingles import WordHash, shingle_set
from reviewloom.session import stage

SHINGLE = 5
#: Percent of the union that two sets share at least.
PERCENT = 85
#: Bands and minima per band: a pair that shares 80 percent has no bucket in common with a chance of 6e-7.
BANDS, ROWS = 36, 5
#: Signatures whose agreement is more than so many standard deviations below the limit are not compared further.
DEVIATIONS = 5
#: Members of a bucket that are compared at once, partners that share one copy of a text, shingles held in a block.
BLOCK, PARTNERS, HELD_SHINGLES = 512, 256, 8_000_000

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _universal(count):
    """Multipliers (odd) and summands of ``count`` hashes x -> a * x + b modulo 2**32."""
    random = np.random.default_rng(1)
    return random.integers(0, 2**32, (2, count, 1), np.uint32) | np.array([[[1]], [[0]]], np.uint32)


def signature(shingles: np.ndarray, hashes) -> bytes:
    """The low 16 bits of the least value of each hash over the set."""
    least = np.full(hashes.shape[1], 2**32 - 1, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), 2048):
        block = values[None, i : i + 2048] * hashes[0] + hashes[1]
        np.minimum(least, block.min(axis=1), out=least)
    return least.astype(np.uint16).tobytes()


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest()


def _sign(shingle, n_hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hashes, seen = WordHash(), _universal(n_hashes), {}
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = hashlib.md5(text, usedforsecurity=False).digest()
                if key not in seen:
                    if len(seen) >= 10_000:
                        seen.clear()
                    own = shingle_set(text.lower().split(), shingle, cache)
                    seen[key] = (len(own), set_digest(own), signature(own, hashes))
                rows.append((doc_id, *seen[key]))
            yield record_batch(rows, _SIGNED)

    return run


def _similar(a, b, percent):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(shingle, percent):
    """Rows sorted by (u, part, v), the text of u first (v is NULL): the pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at, first = WordHash(), None, None
        for batch in slices(batches, "text"):
            rows = []
            for u, part, v, text, digest in zip(*(batch.column(c).to_pylist() for c in ("u", "part", "v", "text", "digest")), strict=True):
                own = shingle_set(text.lower().split(), shingle, cache)
                if set_digest(own) != digest:
                    continue  # another text under the same id
                if v is None:
                    at, first = (u, part), own
                elif at == (u, part) and _similar(first, own, percent):
                    rows.append((u, v))
            if rows:
                yield record_batch(rows, _PAIR)

    return run


class _Sets:
    """Shingle sets of the texts of a block, made when first asked for and held up to a bound."""

    def __init__(self, texts, digests, shingle, cache):
        self.texts, self.digests, self.shingle, self.cache = texts, digests, shingle, cache
        self.held, self.size = {}, 0

    def __getitem__(self, i):
        """The set; None if the text is another one under the same id."""
        if i not in self.held:
            own = shingle_set(self.texts[i].lower().split(), self.shingle, self.cache)
            if self.size + len(own) > HELD_SHINGLES:
                self.held, self.size = {}, 0
            self.held[i] = own if set_digest(own) == self.digests[i] else None
            self.size += len(own)
        return self.held[i]


def _root(parent, x):
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _link(bands, rows, agreement, shingle, percent):
    """Rows sorted by (band, bucket, first, second): the links of each block that join components.

    A pair is looked at in the first band that it shares only. Once a link has
    joined two components, their other pairs are passed over, so a block gives
    fewer links than it has members.
    """

    def block(held, cache):
        band, _, first, second = held[0][:4]
        order = sorted(range(len(held)), key=lambda k: held[k][7] != first)  # the first block ahead
        columns = list(zip(*(held[k] for k in order), strict=True))
        nodes, sizes, labels, blocks = columns[4], np.array(columns[5]), columns[6], np.array(columns[7])
        signatures = np.frombuffer(b"".join(columns[8]), np.uint16).reshape(len(held), bands, rows)
        sets, parent = _Sets(columns[9], columns[10], shingle, cache), {}
        left = np.flatnonzero(blocks == first)
        right = np.flatnonzero(blocks == second)
        for i in left.tolist():
            own = _root(parent, labels[i])
            j = right[right > i]
            j = j[[_root(parent, labels[k]) != own for k in j.tolist()]] if len(j) else j
            j = j[100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])]
            equal = signatures[j] == signatures[i]
            j = j[(equal.all(axis=2).argmax(axis=1) == band) & (equal.mean(axis=(1, 2)) >= agreement)]
            for k in j.tolist():
                a, b = _root(parent, labels[i]), _root(parent, labels[k])
                if a != b and sets[i] is not None and sets[k] is not None and _similar(sets[i], sets[k], percent):
                    parent[b] = a
                    yield tuple(sorted((nodes[i], nodes[k])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cache = [], WordHash()
        for batch in slices(batches, "text"):
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:4] != held[0][:4]:
                    found += block(held, cache)
                    held = []
                held.append(row)
            if found:
                yield record_batch(found, _PAIR)
        found = list(block(held, cache)) if held else []
        if found:
            yield record_batch(found, _PAIR)

    return run


def similar_pairs(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """The pairs (u, v) of class representatives whose full shingle sets are similar.

    Partners of one text stream past it, so a task holds two sets. A text with
    very many partners is repeated once for every ``PARTNERS`` of them.
    """
    counts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    parted = pairs.join(counts, "u").withColumn("part", F.expr("pmod(xxhash64(v), parts)"))
    parted = stage(parted.select("u", "v", "part"), "parted")
    wanted = parted.select("u", "part", F.lit(None).cast("long").alias("v"), F.col("u").alias("node")).distinct()
    wanted = wanted.unionByName(parted.withColumn("node", F.col("v")))
    digests = classes.select(F.col("node").alias("class_node"), "digest")
    wanted = wanted.join(digests, F.col("node") == F.col("class_node")).drop("class_node")
    rows = wanted.join(texts, F.col("node") == F.col("doc_id")).select("u", "part", "v", "text", "digest")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return rows.mapInArrow(_verify(shingle, percent), "u long, v long").distinct()


def _relabelled(nodes, components):
    """``nodes`` with the component that ``components`` (node, component) gives their label."""
    components = components.select(F.col("node").alias("old"), F.col("component").alias("new"))
    joined = nodes.join(components, F.col("label") == F.col("old"), "left")
    return joined.withColumn("label", F.coalesce("new", "label")).drop("old", "new")


def near_duplicates(
    docs: DataFrame, shingle=SHINGLE, percent=PERCENT, bands=BANDS, rows=ROWS, deviations=DEVIATIONS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, per row of ``docs``.

    Words are what ASCII white space separates, A-Z in lower case. Texts of
    fewer than ``shingle`` words are one shingle; NULL texts and texts without
    words have none and are linked with nothing. Rows repeated under one
    doc_id are equal copies; where their texts differ, each row follows its own
    text. A row without doc_id takes the component of its text or, without
    copies, NULL and is kept; it stands for no link between others. An empty
    table gives no row; other columns are not read.
    """
    n_hashes, limit = bands * rows, percent / 100
    agreement = limit - deviations * (limit * (1 - limit) / n_hashes) ** 0.5
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    signed = texts.mapInArrow(
        _sign(shingle, n_hashes), "doc_id long, n_shingles long, digest binary, signature binary"
    )
    signed = stage(signed, "signatures")
    copies = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
    copies = stage(copies.filter("node IS NOT NULL"), "classes")
    classes = signed.join(copies.withColumnRenamed("digest", "class_digest"), F.col("digest") == F.col("class_digest"))
    classes = classes.filter(F.col("doc_id") == F.col("node")).select("node", "digest", "n_shingles", "signature")
    classes = stage(classes.dropDuplicates(["node", "digest"]), "representatives")

    band = [
        F.struct(
            F.lit(b).alias("band"),
            F.xxhash64(F.lit(b), F.substring("signature", b * rows * 2 + 1, rows * 2)).alias("bucket"),
        )
        for b in range(bands)
    ]
    members = classes.select("node", F.inline(F.array(*band)))
    same = ["band", "bucket"]
    buckets = members.groupBy(*same).agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(members.join(buckets, same).select(*same, "n", "u", F.col("node").alias("v")), "members")

    shared = members.filter("u < v").groupBy("u", "v").count()
    first = shared.groupBy("v").agg(F.max(F.struct("count", (-F.col("u")).alias("u"))).alias("best"))
    first = first.select((-F.col("best.u")).alias("u"), "v")
    links = stage(similar_pairs(first, classes, texts, shingle, percent), "links_first")
    labels = classes.select("node", F.col("node").alias("label")).distinct()
    labels = stage(_relabelled(labels, connected_components(links)), "labels_first")

    apart = _members_apart(members, labels, classes, texts)
    links = apart.mapInArrow(_link(bands, rows, agreement, shingle, percent), "u long, v long").distinct()
    links = stage(links, "links_left")
    ends = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    others = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    between = links.join(ends, "u").join(others, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    labels = stage(_relabelled(labels, connected_components(between)), "labels")

    named = copies.join(labels, "node").select(F.col("digest").alias("class_digest"), F.col("label"))
    joined = signed.drop("signature").join(named, F.col("digest") == F.col("class_digest"), "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("label"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _members_apart(members, labels, classes, texts):
    """The members of buckets that hold several components, dealt to blocks and their pairs, with their texts.

    A bucket of ``BLOCK`` members is one row for each; a larger one is cut into
    blocks, and every pair of blocks is a group of its own.
    """
    same = ["band", "bucket"]
    members = members.join(labels.withColumnRenamed("node", "v"), "v").select(*same, "n", "v", "label")
    mixed = members.groupBy(*same).agg(F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = mixed.filter("least <> most").select(*same)
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = members.join(mixed, same).select(
        *same, "v", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("v"), blocks).alias("block")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = rows.select(*same, "v", "label", "block", other).select(
        *same, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "v", "label", "block"
    )
    about = classes.select(F.col("node").alias("v"), "n_shingles", "signature", "digest")
    own = texts.select(F.col("doc_id").alias("v"), "text")
    group = [*same, "one", "two"]
    rows = rows.join(about, "v").join(own, "v")
    rows = rows.select(*group, "v", "n_shingles", "label", "block", "signature", "text", "digest")
    return rows.repartition(*group).sortWithinPartitions(*group, "v")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, all columns.

    Rows under one doc_id stay together if any of them does, rows without one too.
    """
    gone = near_duplicates(docs, **settings).groupBy("doc_id").agg(F.max("kept").alias("stays"))
    gone = stage(gone.filter("NOT stays").select(F.col("doc_id").alias("gone")), "near_gone")
    return whole_rows(docs).join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
