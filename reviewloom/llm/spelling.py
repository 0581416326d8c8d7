"""Spelling variants: words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary is counted with DataFrame functions. Words one edit apart agree
in a beginning and an end that leave an interval of places for the edit. Groups
of words with equal beginning and end are the initial states from which pairs
are enumerated; each pair belongs to the one interval that holds its common
prefix. Intervals of large groups are halved until the groups are small, so
that a beginning of very many words is dealt out. In a partition the minimised
acceptor of its words is composed with the transducer and with itself again.
"""

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import ascii_lower
from reviewloom.session import stage

MIN_LENGTH, MIN_COUNT, TIMES, CORRUPT_EVERY = 7, 2, 10, 31
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a group above which its interval is halved, and words of a partition.
GROUP_WORDS, PARTITION_WORDS = 5_000, 20_000

_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def vocabulary(docs: DataFrame, min_length=MIN_LENGTH, min_count=MIN_COUNT, every=CORRUPT_EVERY) -> DataFrame:
    """word and n: runs of letters with A-Z in lower case, one code point of every ``every``-th (document, run) deleted.

    A row without doc_id counts as one with the empty id. Only code points
    ``RUN`` names are letters; NULL texts have none.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN.replace("A-Za-z", "a-z")), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= min_length)
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words, its states as lists of arcs.

    A state is the number of its first arc (0: none); an arc has a label, the
    state it leads to, whether a word ends there, and the next arc of its
    state. Equal lists are one. ``size[q]``: words accepted from q, which are
    numbered in order.
    """

    def __init__(self, words: Sequence[str]):
        self.label, self.final, self.target, self.sibling, self.size = [""], [False], [0], [0], [0]
        known: dict[tuple, int] = {}
        # (label, final, arcs below) of the path to the last word; an arc is closed when a word has left it
        path: list[list] = []
        top: list[tuple] = []
        for word in [*words, None]:
            common = 0
            if word is not None:
                while common < len(path) and common < len(word) and path[common][0] == word[common]:
                    common += 1
            while len(path) > common:
                label, final, below = path.pop()
                (path[-1][2] if path else top).append((label, final, self._state(below, known)))
            if word is not None:
                path += [[c, False, []] for c in word[common:]]
                path[-1][1] = True
        self.start = self._state(top, known)

    def _state(self, arcs, known) -> int:
        state = 0
        for label, final, target in reversed(arcs):
            key = (label, final, target, state)
            found = known.get(key)
            if found is None:
                found = known[key] = len(self.label)
                self.label.append(label)
                self.final.append(final)
                self.target.append(target)
                self.size.append(final + self.size[target] + self.size[state])
                self.sibling.append(state)
            state = found
        return state

    def arcs(self, state: int) -> Iterator[tuple]:
        """(label, final, target, number of the first word by this arc, counted from the state)."""
        before = 0
        while state:
            yield self.label[state], self.final[state], self.target[state], before
            before += self.final[state] + self.size[self.target[state]]
            state = self.sibling[state]

    def common(self, first: int, second: int, i: int, j: int, skip="") -> Iterator[tuple[int, int]]:
        """Numbers of the words that both states accept, from ``i`` and ``j`` on; ``skip``: a label not to begin with."""
        todo = [(first, second, i, j, skip)]
        label, final, target, sibling, size = self.label, self.final, self.target, self.sibling, self.size
        while todo:
            p, q, i, j, skip = todo.pop()
            if p == q and not skip:
                yield from zip(range(i, i + size[p]), range(j, j + size[p]), strict=True)
                continue
            while p and q:
                if label[p] == label[q]:
                    if label[p] != skip:
                        if final[p] and final[q]:
                            yield i, j
                        if target[p] and target[q]:
                            todo.append((target[p], target[q], i + final[p], j + final[q], ""))
                    i, p = i + final[p] + size[target[p]], sibling[p]
                    j, q = j + final[q] + size[target[q]], sibling[q]
                elif label[p] < label[q]:
                    i, p = i + final[p] + size[target[p]], sibling[p]
                else:
                    j, q = j + final[q] + size[target[q]], sibling[q]

    def one_edit(self, state: int, ends: bool) -> Iterator[tuple[int, int]]:
        """Pairs accepted from (state, no edit yet, state) when the edit is made here.

        Numbers count from the first word that passes the state; ``ends``: one
        ends in it and is number 0. Each unordered pair comes once: labels
        replace later ones, and a label is inserted in the second word only
        where the first does not go on with it.
        """
        arcs = list(self.arcs(state))
        skipped = int(ends)
        for k, (x, x_final, x_target, x_at) in enumerate(arcs):
            i = skipped + x_at
            if ends and x_final:
                yield 0, i
            yield from self.common(state, x_target, skipped, i + x_final, skip=x)
            for _, y_final, y_target, y_at in arcs[k + 1 :]:
                j = skipped + y_at
                if x_final and y_final:
                    yield i, j
                if x_target and y_target:
                    yield from self.common(x_target, y_target, i + x_final, j + y_final)


def near_pairs(words: Sequence[str], low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs of numbers of sorted distinct ``words`` one edit apart, each once.

    Only pairs of ``low`` or more, but less than ``high``, common first code
    points. The composition is done once for each state and counted again at
    each path to it.
    """
    machine = Acceptor(words)
    composed: dict[tuple, list] = {}
    todo = [(machine.start, False, 0, 0)] if words else []
    while todo:
        state, ends, first, depth = todo.pop()
        if not state:
            continue
        if depth >= low:
            pairs = composed.get((state, ends))
            if pairs is None:
                pairs = composed[state, ends] = list(machine.one_edit(state, ends))
            for i, j in pairs:
                yield first + i, first + j
        if depth + 1 < high:
            for _, final, target, before in machine.arcs(state):
                todo.append((target, final, first + ends + before, depth + 1))


def _with_parts(keys: DataFrame) -> DataFrame:
    """The group of each key: the words that agree before and after its interval [low, high) of places of the edit."""
    length = F.length("word")
    end = F.greatest(F.col("shorter") - F.col("high"), F.lit(0))
    prefix, suffix = F.substring("word", F.lit(1), F.col("low")), F.substring("word", length - end + 1, end)
    return keys.withColumn("group", F.xxhash64("shorter", "low", "high", F.xxhash64(prefix), F.xxhash64(suffix)))


def _halves(keys: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    both = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return _with_parts(keys.select("word", "n", "shorter", F.inline(both)))


def keyed_words(words: DataFrame, group_words=GROUP_WORDS) -> DataFrame:
    """word, n, shorter (length of the shorter word of a pair), low, high, group: every word in its groups.

    A word is the longer one of pairs with words one code point shorter, and
    the shorter or equal one of others. Groups above ``group_words`` are halved
    while their interval has two places or more; below that only words that
    differ in one or two given places are left, so that no group is unbounded.
    """
    length = F.length("word")
    whole = words.select(
        "word", "n", F.explode(F.array(length, length - 1)).alias("shorter"), F.lit(0).alias("low")
    ).withColumn("high", F.col("shorter") + 1)
    open_, done = _halves(whole), []
    while True:
        open_ = stage(open_, "keyed-words")
        sizes = open_.filter(F.col("high") - F.col("low") > 1).groupBy("group").agg(F.count(F.lit(1)).alias("size"))
        large = stage(sizes.filter(F.col("size") > group_words).select("group"), "large-groups")
        if large.isEmpty():
            return _stacked([*done, open_])
        done.append(open_.join(large, "group", "left_anti"))
        open_ = _halves(open_.join(large, "group", "left_semi"))


def _stacked(tables):
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def _enumerate(table: pa.Table) -> pa.Table:
    """For each word of a partition's groups the number of near words and the one of largest n there."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("group", "shorter", "low", "high", "word", "n")), strict=True))
    near: dict[str, list] = {}

    def meet(word, n, other):
        found = near.setdefault(word, [0, 0, ""])
        found[0] += 1
        if n > found[1] or n == found[1] and other < found[2]:
            found[1], found[2] = n, other

    for (_, shorter, low, high), group in groupby(rows, key=lambda row: row[:4]):
        words, counts = zip(*(row[4:] for row in group), strict=True)
        if len(words) == 1:
            continue
        for i, j in near_pairs(words, low, high):
            if min(len(words[i]), len(words[j])) == shorter:
                meet(words[i], counts[j], words[j])
                meet(words[j], counts[i], words[i])
    rows = [(w, *found) for w, found in near.items()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _NEAR.types, strict=True)], schema=_NEAR)


def near_words(words: DataFrame, group_words=GROUP_WORDS, partition_words=PARTITION_WORDS) -> DataFrame:
    """word, n_near, near_n, near: words with a near one, their number, and the one of largest n (then smallest)."""
    keys = stage(keyed_words(words, group_words), "grouped-words")
    partitions = max(1, -(-keys.count() // partition_words))
    dealt = keys.withColumn("partition", F.pmod("group", F.lit(partitions)))
    found = dealt.groupBy("partition").applyInArrow(_enumerate, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near")
    )


def roots(links: DataFrame) -> DataFrame:
    """word and root, the last word when forms are followed; ``links``: word and form.

    Each round a way of forms doubles. A form has ten times the occurrences,
    so that no way is longer than twenty.
    """
    current = stage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not current.filter("open").isEmpty():
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = stage(
            current.join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")
            ),
            "roots",
        )
    return current.select("word", "root")


def spelling_variants(docs: DataFrame, times=TIMES, group_words=GROUP_WORDS, partition_words=PARTITION_WORDS, **words) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary.

    ``form``: the near word of largest n (ties: the smallest) where that is at
    least ``times`` n; ``root``: the last one when forms are followed from the
    word. NULL and empty texts and texts without letters give no word, and an
    empty table no row. Runs of letters are words at any length (the time of a
    run grows with it). Rows count each, with or without an id; other columns
    are not read.
    """
    counted = stage(vocabulary(docs, **words), "vocabulary")
    near = near_words(counted, group_words, partition_words)
    is_form = F.col("near_n") >= times * F.col("n")
    forms = counted.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    forms = stage(forms, "forms")
    found = roots(forms.filter(F.col("form").isNotNull()).select("word", "form"))
    return forms.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
