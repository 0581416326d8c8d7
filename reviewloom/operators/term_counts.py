"""Counts of words and their runs in a block of rows.

Kept apart from the features, so that a Python worker loads NumPy and Arrow alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task holds to count their terms; a longer row is held whole.
COUNTED_AT_ONCE = 1_000_000
#: Bytes of words that go to a task at once: they are held beside the words that it counts.
SENT_AT_ONCE = 4 * 2**20


def _tally(terms, code, rows):
    """(term, df, cf) of the terms with these numbers in these rows."""
    size = len(terms)
    places = np.sort(rows * size + code)
    found = places[np.diff(places, prepend=-1) != 0] % max(size, 1)
    counts = [pa.array(np.bincount(c, minlength=size).astype(np.int64)) for c in (found, code)]
    return pa.RecordBatch.from_arrays([terms, *counts], names=["term", "df", "cf"])


def _count_block(lists, n_max):
    """(term, df, cf) of some rows, given as an array of word lists; one batch for each length of runs."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lengths)
    words = lists.flatten().dictionary_encode("encode")
    names, word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    yield _tally(names, word, rows)
    terms, code, starts = names, word, np.arange(len(word))
    for n in range(2, n_max + 1):
        whole = starts + (n - 1) < len(word)
        whole[whole] = rows[starts[whole]] == rows[starts[whole] + n - 1]
        starts, code = starts[whole], code[whole]
        # numbers stand for the words, so that a run is one number, and only distinct ones become text
        pairs, code = np.unique(code * len(names) + word[starts + n - 1], return_inverse=True)
        parts = [values.take(pa.array(i)) for values, i in ((terms, pairs // max(len(names), 1)), (names, pairs % max(len(names), 1)))]
        terms = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        yield _tally(terms, code, rows[starts])


def count_in_blocks(n_max):
    """A function for ``mapInArrow`` over a column of lists, or for ``n_max`` above 1 of words joined by spaces."""
    most = COUNTED_AT_ONCE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            lists = batch.column(0) if n_max == 1 else pc.split_pattern(batch.column(0), " ")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(lists):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + (most - words), "right")))
                held.append(lists.slice(start, stop - start))
                words += int(ends[min(stop, len(ends)) - 1] - before)
                start = stop
                if words >= most or start < len(lists):
                    yield from _count_block(pa.chunked_array(held).combine_chunks(), n_max)
                    held, words = [], 0
        if words:
            yield from _count_block(pa.chunked_array(held).combine_chunks(), n_max)

    return count
