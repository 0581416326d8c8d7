"""What tasks do in a pass of the solver: rows packed as plain numbers, and their sums.

Kept apart from the solver, so that a Python worker loads NumPy and Arrow alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Weights whose gradient is one row of a partial sum, and rows and entries (at most, if there is more than one row) packed as one.
BLOCK, PACK, PACKED_ENTRIES = 2**15, 2**14, 2**18
_PARTIAL = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
_PACKED = pa.schema([("labels", pa.binary()), ("weights", pa.binary()), ("lengths", pa.binary()), ("indices", pa.binary()), ("values", pa.binary())])
PACKED = ", ".join(f"{name} binary" for name in _PACKED.names)
_TYPES = (np.int32, float, np.int32, np.int32, float)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, weight, indices, values) as few rows of plain numbers, which every pass reads without taking lists apart."""
    for whole in batches:
        ends, start = whole.column("indices").offsets.to_numpy(), 0
        while start < whole.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + PACKED_ENTRIES, "right")) - 1
            batch = whole.slice(start, max(1, min(stop - start, PACK)))
            start += batch.num_rows
            indices, values = batch.column("indices"), batch.column("values")
            lengths = np.diff(indices.offsets.to_numpy())
            columns = (batch.column("label"), batch.column("weight"), lengths, indices.flatten(), values.flatten())
            packed = [np.asarray(c).astype(t).tobytes() for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], schema=_PACKED)


def _unpack(batches):
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            label, weight, lengths, index, value = (np.frombuffer(c.as_buffer(), t) for c, t in zip(row, _TYPES, strict=True))
            yield label, weight, lengths, index.astype(np.intp), value


def _row_sums(entries, lengths):
    """The sum of each row's entries, which follow each other; a row may have none."""
    out, filled = np.zeros(len(lengths), entries.dtype), lengths > 0
    if len(entries):
        out[filled] = np.add.reduceat(entries, (np.cumsum(lengths) - lengths)[filled])
    return out


def _blocks(out):
    sums = [out[s : s + BLOCK].tobytes() for s in range(0, len(out), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.binary())], schema=_PARTIAL)


def _squares(width):
    """The weighted sum of squares of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for _, weight, lengths, index, value in _unpack(batches):
            out += np.bincount(index, np.repeat(weight, lengths) * value * value, width)
        yield _blocks(out)

    return run


def _pass(shared, n_classes):
    """Loss and gradient of a task's rows, as blocks of one long vector: loss, intercepts, then weights class by class.

    Probabilities follow from the differences to the first class, and errors of
    a row add up to 0: the first class needs no sums of its own. Two of the
    others are one complex number, so that an entry is looked up once for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts = shared.value
        width = weights.shape[1]
        others = [weights[k] - weights[0] for k in range(1, n_classes)]
        pairs = [others[k] + 1j * (others[k + 1] if k + 1 < len(others) else 0) for k in range(0, len(others), 2)]
        out = np.zeros(1 + n_classes * (1 + width))
        slopes = out[1 + n_classes :].reshape(n_classes, width)
        for label, weight, lengths, index, value in _unpack(batches):
            rows = np.arange(len(label))
            logits = np.zeros((n_classes, len(label)))
            for k, pair in enumerate(pairs):
                entries = pair.take(index)
                entries *= value
                sums = _row_sums(entries, lengths)
                logits[2 * k + 1 : 2 * k + 3] = [sums.real, sums.imag][: n_classes - 1 - 2 * k]
            logits += (intercepts - intercepts[0])[:, None]
            top = logits.max(axis=0)
            e = np.exp(logits - top)
            total = e.sum(axis=0)
            out[0] += (weight * (top + np.log(total) - logits[label, rows])).sum()
            error = e / total
            error[label, rows] -= 1
            error *= weight
            out[1 : 1 + n_classes] += error.sum(axis=1)
            for k in range(1, n_classes):
                entries = np.repeat(error[k], lengths)
                entries *= value
                slopes[k] += np.bincount(index, entries, width)
        slopes[0] = -slopes[1:].sum(axis=0)
        yield _blocks(out)

    return run


def _sum_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, float) for b in table.column("sums").to_pylist())
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_PARTIAL)
