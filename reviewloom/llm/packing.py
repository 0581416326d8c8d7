"""Documents packed into sequences of bounded length by a grouping genetic algorithm.

Pieces of documents are dealt at random to chunks of bounded size. Islands, a
few for each chunk, evolve populations of packings as separate tasks:
crossover injects whole well-filled bins of one parent into the other, the
bins that then hold a piece twice are removed, and the displaced pieces are
placed by best fit. Between epochs the best packing of an island migrates to
the next one of its chunk, until several epochs bring no gain. Pieces of badly
filled bins are dealt anew to fewer chunks, until a round saves no sequence.
"""

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import record_batch, slices, utf8
from reviewloom.session import stage

CAPACITY = 4096
END_ID = 1
#: Pieces in a chunk, islands of a chunk, packings on an island, and generations in an epoch.
CHUNK, ISLANDS, POPULATION, GENERATIONS = 4096, 2, 4, 25
#: The search of a chunk ends where its bins are as few as their contents allow, or after so many epochs without gain;
#: all chunks end after so many epochs at most.
PATIENCE, EPOCHS = 2, 40
#: A bin filled to this share stays as it is when the rest is dealt anew.
FULL = 0.995
#: Rounds at most, should each go on to save sequences.
ROUNDS = 20
#: Bytes of texts that a task is sent, and looks up, at once; it holds a longer text whole.
SLICE = 4_000_000
#: Odd parts of texts and words whose ids a worker remembers, and their longest.
_CACHE_PARTS, _CACHE_WORDS, _CACHE_LENGTH = 50_000, 250_000, 64

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = pa.schema([("row", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64())])


def _byte_letters():
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Known:
    """Ids of words, as Arrow arrays of a few bytes a word: a worker lives on after its task, and so do these.

    Of more than ``size`` words, at most half stay: those that were in more slices than the median word.
    """

    def __init__(self, size):
        self.size = size
        self.words, self.ids, self.uses = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def of(self, words: pa.Array, encode) -> pa.Array:
        """The ids of distinct words; those not known are learned in one go."""
        found = pa.compute.index_in(words, value_set=self.words)
        unknown = words.filter(found.is_null())
        learned = pa.array(encode(unknown.to_pylist()), pa.large_binary())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        self.uses[at[at >= 0]] += 1
        at[at < 0] = len(self.words) + np.arange(len(unknown))
        ids = pa.concat_arrays([self.ids, learned]).take(pa.array(at))
        short = pa.compute.less_equal(pa.compute.utf8_length(unknown), _CACHE_LENGTH)
        self.words = pa.concat_arrays([self.words, unknown.filter(short)])
        self.ids = pa.concat_arrays([self.ids, learned.filter(short)])
        self.uses = np.append(self.uses, np.ones(len(self.words) - len(self.uses), np.int64))
        if len(self.words) > self.size:
            stay = self.uses > np.median(self.uses)
            self.words, self.ids, self.uses = self.words.filter(stay), self.ids.filter(stay), self.uses[stay] // 2
        return ids


class WordIds:
    """Token ids, as little-endian 32-bit numbers, of what ASCII white space separates.

    The tokenizer drops white space, its pre-tokens never cross it, and its
    merges never cross a pre-token; so the ids of a text are those of its
    parts, one after the other. Letters and the ASCII marks after them are
    separate pre-tokens too, and letters are put in lower case. Parts of Latin
    letters, precomposed ones included, are cut so; all others go to the
    tokenizer whole.
    """

    _word = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # special tokens inside a text are found as such, whatever stands around them
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.words = _Known(_CACHE_PARTS), _Known(_CACHE_WORDS)

        self.direct = True  # whether the merges alone, over the byte-level alphabet, give the same ids
        probes = ["the", "tokenizer", "qzx", ",", "!!)", "stra\u00dfe", "\u00e9\u00e8"]
        self.direct = self._encode(probes) == self._encode_plain(probes)

    def _encode(self, texts):
        """The ids of parts of any kind."""
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _encode_plain(self, words):
        """The ids of letters in lower case, or of ASCII marks: single pre-tokens that nothing changes."""
        if not self.direct:
            return self._encode(words)
        tokenize = self.tokenizer.model.tokenize
        found, ends = [], [0]
        for word in words:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            found += [token.id for token in tokenize(letters)]
            ends.append(4 * len(found))
        ids = np.array(found, "<u4").tobytes()
        return [ids[i:j] for i, j in zip(ends, ends[1:])]

    def _of_parts(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts without white space."""
        cut = pa.compute.extract_regex(parts, pattern=self._word)
        letters, marks = (pa.compute.struct_field(cut, [i]).dictionary_encode() for i in (0, 1))
        lower = pa.compute.utf8_lower(letters.dictionary).dictionary_encode()
        word_ids = self.words.of(lower.dictionary, self._encode_plain).take(lower.indices.take(letters.indices))
        mark_ids = self.words.of(marks.dictionary, self._encode_plain).take(marks.indices)
        ids = pa.compute.binary_join_element_wise(word_ids, mark_ids, pa.scalar(b"", pa.large_binary()))
        whole = cut.is_null()
        if not pa.compute.any(whole).as_py():
            return ids
        other = self.parts.of(parts.filter(whole), self._encode)
        return pa.compute.replace_with_mask(ids, whole, other)

    def of_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of binary texts: each distinct part of all of them is looked up once, the rest is Arrow's."""
        special = [any(s in text for s in self.special) for text in texts.to_pylist()]
        try:
            strings = texts.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            strings = pa.array([text.decode("utf-8", "replace") for text in texts.to_pylist()], pa.string())
        parts = pa.compute.ascii_split_whitespace(strings)
        coded = parts.flatten().dictionary_encode()
        taken = self._of_parts(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[parts.offsets.to_numpy()].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [
            b"".join(self._encode(own.as_py())) if alone else bytes(data[a:b])
            for own, alone, a, b in zip(parts, special, ends[:-1], ends[1:], strict=True)
        ]

    def of(self, text: bytes) -> bytes:
        return self.of_all(pa.array([text], pa.binary()))[0]


def _word_ids(path) -> WordIds:
    """The ids known to this worker process, which later tasks use again; kept with the tokenizer library."""
    import tokenizers

    known = tokenizers.__dict__.setdefault("_ids_of_words", {})
    if path not in known:
        known[path] = WordIds(path)
    return known[path]


def _tokenize(path, capacity, end_id):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = _word_ids(path)
        for batch in slices(batches, "text", SLICE):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), word_ids.of_all(batch.column("text")), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield record_batch(rows, _PIECES)

    return run


def document_pieces(docs: DataFrame, path, capacity=CAPACITY, end_id=END_ID) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of the ids, for every piece of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return texts.mapInArrow(_tokenize(str(path), capacity, end_id), _PIECES_DDL)


# Packings: a list of bins, each a list of positions in the array of lengths.


def best_fit(order, lengths, bins, capacity):
    """Places the pieces one by one where the least room is left over; changes ``bins``."""
    rooms, free = {}, 0  # bins by free room, and the rooms there are as bits
    for b in bins:
        room = capacity - sum(lengths[i] for i in b)
        rooms.setdefault(room, []).append(b)
        free |= 1 << room
    for i in order:
        need = lengths[i]
        enough = free >> need
        if enough:
            room = need + (enough & -enough).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, b = capacity, []
            bins.append(b)
        b.append(i)
        room -= need
        rooms.setdefault(room, []).append(b)
        free |= 1 << room
    return bins


def fitness(bins, lengths, capacity):
    """Fewer bins first, then the mean square of how far they are filled."""
    filled = [sum(lengths[i] for i in b) / capacity for b in bins]
    return (-len(bins), sum(f * f for f in filled) / max(1, len(bins)))


def crossover(mother, father, lengths, capacity, random):
    """Well-filled bins of ``father`` go whole into ``mother``; pieces of bins that clash are placed by best fit."""
    full = sorted(father, key=lambda b: -sum(lengths[i] for i in b))[: max(1, len(father) // 2)]
    injected = [list(full[k]) for k in random.choice(len(full), max(1, len(full) // 2), replace=False)]
    there = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in mother:
        if there.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in there]
    return best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths, injected + kept, capacity)


def mutation(bins, lengths, capacity, random):
    """The worst bins and a few others are emptied and their pieces placed by best fit."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = {*order[:2], *(int(k) for k in random.integers(0, len(bins), 2))}
    pieces = [i for k in gone for i in bins[k]]
    random.shuffle(pieces)
    return best_fit(pieces, lengths, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(lengths, population, capacity, generations, size, seed):
    """The population after some generations, the best first. An empty one starts from best fit in falling order."""
    random = np.random.default_rng(seed)
    score = lambda bins: fitness(bins, lengths, capacity)
    least = -(-sum(lengths) // capacity)
    population = [p for p in population if p]
    if not population:
        population = [best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, [], capacity)]
    while len(population) < size and len(population[0]) > least:
        noisy = np.array(lengths) * random.uniform(0.85, 1.0, len(lengths))
        population.append(best_fit(np.argsort(-noisy).tolist(), lengths, [], capacity))
    population = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)[:size]
    for generation in range(generations):
        if len(population[0][2]) <= least or len(population) < 2:
            break  # no packing has fewer bins
        a, b = sorted(random.choice(len(population), 2, replace=False))
        child = crossover(population[b][2], population[a][2], lengths, capacity, random)
        child = mutation(child, lengths, capacity, random)
        population[-1] = max(population[-1], (score(child), size + generation, child), key=lambda x: x[0])
        population.sort(key=lambda x: x[:2], reverse=True)
    return [p for _, _, p in population]


def _as_numbers(bins, n):
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def _as_bins(numbers):
    bins = [[] for _ in range(max(numbers) + 1)] if numbers else []
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


_ISLAND = pa.schema(
    [
        ("chunk", pa.int64()),
        ("island", pa.int32()),
        ("rows", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("population", pa.list_(pa.list_(pa.int32()))),
        ("bins", pa.int32()),
        ("score", pa.float64()),
    ]
)
_ISLAND_DDL = (
    "chunk long, island int, rows array<long>, lengths array<int>, population array<array<int>>, bins int, score double"
)


def _epoch(number, capacity, generations, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                population = [_as_bins(p) for p in row["population"]]
                seed = [row["chunk"], row["island"], number]
                population = evolve(lengths, population, capacity, generations, size, seed)
                count, square = fitness(population[0], lengths, capacity)
                numbers = [_as_numbers(p, len(lengths)) for p in population]
                yield record_batch([(row["chunk"], row["island"], row["rows"], lengths, numbers, -count, square)], _ISLAND)

    return run


def _place(capacity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, out = row["lengths"], []
                for k, b in enumerate(_as_bins(row["best"])):
                    filled, at = sum(lengths[i] for i in b), 0
                    for i in b:
                        out.append((row["rows"][i], row["chunk"] << 14 | k, at, filled))
                        at += lengths[i]
                yield record_batch(out, _PLACED)

    return run


def evolve_chunks(
    pieces: DataFrame, n_chunks, capacity, number=0, islands=ISLANDS, size=POPULATION, epochs=EPOCHS, generations=GENERATIONS
):
    """Places ``pieces`` (row, length): row, bin, offset and how far the bin is filled; ``number``: of the round."""
    chunk = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(n_chunks)).alias("chunk")
    # rows are distinct and hashed, so a chunk has a bounded number of them
    chunks = pieces.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("length", "row"))).alias("pieces"))
    state = chunks.select(
        "chunk",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("pieces.row").alias("rows"),
        F.col("pieces.length").cast("array<int>").alias("lengths"),
        F.array().cast("array<array<int>>").alias("population"),
        F.lit(0).alias("bins"),
        F.lit(0.0).alias("score"),
    ).repartition("chunk", "island")
    ended, before = [], None
    for epoch in range(epochs):
        state = stage(state.mapInArrow(_epoch(epoch, capacity, generations, size), _ISLAND_DDL), "islands")
        gains = _gains(state, before, capacity)
        if epoch + 1 == epochs or gains.filter("open").isEmpty():
            break
        # chunks that have ended leave the search; the others go on with the elite of a neighbour island
        gains = stage(gains, "gains")
        closed = gains.filter("NOT open").select("chunk")
        ended.append(state.join(closed, "chunk", "left_semi"))
        before = gains.filter("open")
        state = state.join(before.select("chunk"), "chunk", "left_semi")
        elite = state.select(
            "chunk", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite")
        )
        state = state.join(elite, ["chunk", "island"]).withColumn("population", F.concat(F.array("elite"), "population"))
        state = state.select(*_ISLAND.names)
    for part in ended:
        state = state.unionByName(part)
    winner = state.groupBy("chunk").agg(
        F.max(F.struct((-F.col("bins")).alias("fewer"), "score", (-F.col("island")).alias("first"))).alias("w")
    )
    winner = winner.select("chunk", (-F.col("w.first")).alias("island"))
    best = state.join(winner, ["chunk", "island"]).select("chunk", "rows", "lengths", F.col("population")[0].alias("best"))
    return best.mapInArrow(_place(capacity), "row long, bin long, offset long, filled long")


def _gains(state, before, capacity):
    """chunk, bins of its best island, epochs without gain, and whether its search goes on."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    now = state.groupBy("chunk").agg(F.min("bins").alias("bins"), F.max(F.ceil(total / capacity)).alias("least"))
    if before is None:
        idle = F.lit(0)
    else:
        now = now.join(before.select("chunk", F.col("bins").alias("was"), F.col("idle").alias("were_idle")), "chunk")
        idle = F.when(F.col("bins") < F.col("was"), 0).otherwise(F.col("were_idle") + 1)
    now = now.withColumn("idle", idle)
    return now.select("chunk", "bins", "idle", ((F.col("bins") > F.col("least")) & (F.col("idle") < PATIENCE)).alias("open"))


def pack(pieces: DataFrame, capacity=CAPACITY, chunk=CHUNK) -> DataFrame:
    """``pieces`` (row, length; rows distinct) with sequence_id and offset.

    A round packs what is left, and keeps the bins that are ``FULL``. The
    pieces of the others are dealt anew while that saves a sequence.
    """
    settled = pieces.filter(F.col("length") >= capacity).select(
        "row", (F.col("row") + F.lit(2**62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, earlier = pieces.filter(F.col("length") < capacity), None
    for number in range(ROUNDS):
        facts = rest.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
        if not facts.n:
            break
        if earlier is not None and earlier[1] <= -(-facts.total // capacity):
            return settled.unionByName(earlier[0])  # they are in as few sequences as can be
        placed = stage(evolve_chunks(rest, -(-facts.n // chunk), capacity, number), "placed")
        n_bins = placed.filter(F.col("offset") == 0).count()  # every bin has one piece at its begin
        if earlier is not None and n_bins >= earlier[1]:
            return settled.unionByName(earlier[0])
        numbered = F.shiftleft(F.lit(number).cast("long"), 56) + F.col("bin")
        placed = placed.withColumn("sequence_id", numbered)
        full = F.col("filled") >= FULL * capacity
        loose = placed.filter(~full)
        settled = settled.unionByName(placed.filter(full).select("row", "sequence_id", "offset"))
        earlier = loose.select("row", "sequence_id", "offset"), loose.filter(F.col("offset") == 0).count()
        rest = stage(rest.join(loose.select("row"), "row"), "again")
    return settled if earlier is None else settled.unionByName(earlier[0])


def pack_documents(docs: DataFrame, tokenizer_path, capacity=CAPACITY, end_id=END_ID, chunk=CHUNK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of ``docs``.

    Only documents of more than ``capacity`` ids are cut. NULL and empty texts
    are the end id alone. Rows repeated under one doc_id, or without one, are
    documents of their own, each packed. An empty table gives no row; other
    columns are not read.
    """
    pieces = document_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces", SLICE)
    placed = pack(pieces.select("row", "length"), capacity, chunk)
    return pieces.join(placed, "row").drop("row")
