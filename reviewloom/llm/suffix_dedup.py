"""Repeated passages, byte by byte, by sorted suffixes.

Sorting a suffix of every byte would need many times the input as shuffle.
Instead every window of ``SPAN`` bytes names its token of ``TOKEN`` bytes with
the least hash; equal windows name the same one, and neighbouring windows
mostly do. A *cell* is a run of windows with one leading token, about one for
14 bytes, and stands for the suffixes that start in it.

1. Splitters sampled from the tokens range-partition all cells. Only 32 bits of
   a token travel, one per block of texts however often the block has it; a
   bucket sorts them and names those that occur twice.
2. Cells with such a token travel with their bytes, again one per block. A
   bucket sorts its suffixes (the windows of the cells) by a multikey
   quicksort and finds the smallest document of each run of equal ones.
3. Texts are read once more, and the bytes of windows that a smaller document
   has are removed.

A range starts at a token, so equal suffixes meet in one bucket and a run never
crosses its boundary. In the first step a token of a third of the corpus is one
entry per block. Its cells are not: those at the edges of a shared passage hold
each document's own bytes. Cells of a token that has more than ``HOT_CELLS`` of
them are therefore cut into single windows, and the hash of a whole window, no
longer the token alone, names the bucket: equal windows still meet, one per
block, and the others are dealt out evenly. Texts are not shuffled: what a block has to know is written to the
shared folder under its number, and the task that reads the block fetches it.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import filesystem, record_batch, slices, utf8
from reviewloom.session import stage, stage_path

SPAN, TOKEN = 50, 24
#: Windows that can have one leading token.
REACH = SPAN - TOKEN + 1
#: Windows that are hashed at once, cells that a task holds back to merge equal ones, bytes of text per bucket.
PIECE, HELD, BUCKET_BYTES = 500_000, 200_000, 64_000_000
#: Cells from which on those of one token are dealt out window by window, windows of them a bucket, windows sorted at once.
HOT_CELLS, HOT_WINDOWS, SORTED_WINDOWS = 20_000, 500_000, 500_000
#: Documents and tokens of each that the splitters are sampled from.
SAMPLED_DOCUMENTS, SAMPLED_TOKENS = 2000, 50

_NO_ID = 2**63 - 1  # a row without id is larger than all others
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a, b):
    x = a * _A
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _short(tokens):
    """32 bits of a token, for comparison inside a bucket."""
    return ((tokens * _B) >> np.uint64(32)).astype(np.uint32)


def window_hashes(data: np.ndarray):
    """For every window of ``SPAN`` bytes the least hash of its tokens, and the hash of the whole window."""
    n = len(data) - SPAN + 1
    one = (data.astype(np.uint64) + np.uint64(1)) * _B
    two = _mix(one[:-1], one[1:])
    four = _mix(two[:-2], two[2:])
    eight = _mix(four[:-4], four[4:])
    sixteen = _mix(eight[:-8], eight[8:])
    token = _mix(sixteen[: n + REACH - 1], eight[16 : 16 + n + REACH - 1])
    half = _mix(sixteen[:-16], sixteen[16:])
    whole = _mix(half[:n], half[SPAN - 32 : SPAN - 32 + n])
    least, width = token, 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[:n], least[REACH - width : REACH - width + n])
    return least[:n], whole


def _cell_keys(least, whole, first, count):
    """The leading token and the hash of the cells at ``first``; first and last window cover a cell."""
    return least[first], _mix(_mix(whole[first], whole[first + count - 1]), count.astype(np.uint64))


class Cells:
    """The cells of some texts: text number, first window in the text, windows, token, hash, and place in ``data``."""

    def __init__(self, parts):
        """``parts``: (text number, offset in the text, bytes), each at least ``SPAN`` long."""
        self.data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        begins = np.cumsum(sizes) - sizes
        least, whole = window_hashes(self.data)
        fresh = np.empty(len(least), bool)
        fresh[0], fresh[1:] = True, least[1:] != least[:-1]
        fresh[begins] = True
        ends = begins + sizes - SPAN + 1  # the windows from here on reach into the next text
        fresh[ends[:-1]] = True
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(least)))
        part = np.searchsorted(begins, first, "right") - 1
        inside = first < ends[part]
        first, count, part = first[inside], count[inside], part[inside]
        count = np.minimum(count, ends[part] - first)
        if len(count) and count.max() > REACH:  # one token again and again: cut into equal lengths
            times = -(-count // REACH)
            again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rest = np.repeat(count, times) - again * REACH
            first, part = np.repeat(first, times) + again * REACH, np.repeat(part, times)
            count = np.minimum(rest, REACH)
        self.place, self.count = first, count
        self.token, self.hash = _cell_keys(least, whole, first, count)
        self.whole = whole
        numbers, offsets = np.array([n for n, _, _ in parts]), np.array([o for _, o, _ in parts])
        self.text, self.start = numbers[part], first - begins[part] + offsets[part]

    def cut(self, chosen):
        """Cuts the ``chosen`` cells into cells of one window."""
        if not chosen.any():
            return
        times = np.where(chosen, self.count, 1)
        again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(chosen, times)
        self.place, self.start = np.repeat(self.place, times) + again, np.repeat(self.start, times) + again
        self.text, self.token = np.repeat(self.text, times), np.repeat(self.token, times)
        self.count, self.hash = np.where(single, 1, np.repeat(self.count, times)), np.repeat(self.hash, times)
        at = self.place[single]
        self.hash[single] = _mix(_mix(self.whole[at], self.whole[at]), np.ones(len(at), np.uint64))

    def content(self, i) -> bytes:
        return self.data[self.place[i] : self.place[i] + self.count[i] + SPAN - 1].tobytes()


def cells_of(texts: list[bytes], piece=PIECE) -> Iterator[Cells]:
    """The cells of ``texts``, a bounded number of windows at a time; long texts in overlapping parts."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - SPAN + 1), piece):
            part = text[at : at + piece + SPAN - 1]
            if held and size + len(part) > piece + SPAN:
                yield Cells(held)
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        yield Cells(held)


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of ``tokens`` by their first column, and rows equal so far by the next, and so on."""
    order = np.argsort(tokens[:, 0], kind="stable")
    tied = np.zeros(len(order), np.int64)  # number of the group that a place belongs to
    for depth in range(1, tokens.shape[1]):
        last = tokens[order, depth - 1]
        tied = np.cumsum(np.append(True, (last[1:] != last[:-1]) | (tied[1:] != tied[:-1])))[: len(order)]
        sizes = np.bincount(tied)
        open_ = np.flatnonzero(sizes[tied] > 1)
        if not len(open_):
            break
        rows = order[open_]
        order[open_] = rows[np.lexsort((tokens[rows, depth], tied[open_]))]
    return order


def _runs(changes):
    """Numbers of runs, given where a new one starts."""
    return np.cumsum(changes) - 1


def smallest_documents(content: list[bytes], group: np.ndarray, document: np.ndarray):
    """For different cells with their smallest documents: (cell, first window, last window, smallest document).

    Windows are compared inside a ``group``, the cells of one token.
    """
    counts = np.array([len(c) - SPAN + 1 for c in content])
    sizes = counts + SPAN - 1
    begins = np.cumsum(sizes) - sizes
    cell = np.repeat(np.arange(len(content)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.frombuffer(b"".join(content), np.uint8)
    padded = np.zeros((len(cell), -(-SPAN // 8) * 8), np.uint8)
    padded[:, :SPAN] = np.lib.stride_tricks.sliding_window_view(data, SPAN)[begins[cell] + window]
    suffixes = np.column_stack([group[cell].astype(np.uint64), padded.view(">u8").astype(np.uint64)])
    order = multikey_order(suffixes)
    suffixes = suffixes[order]
    run = _runs(np.append(True, (suffixes[1:] != suffixes[:-1]).any(axis=1)))
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    least = np.empty(len(cell), np.int64)
    least[order] = np.minimum.reduceat(document[cell][order], starts)[run]
    first = np.append(True, (cell[1:] != cell[:-1]) | (least[1:] != least[:-1]))
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(cell)) - 1
    return cell[at], window[at], window[last], least[at]


# Tables


_BLOCKS = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("text", pa.binary())])
_TOKENS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("times", pa.binary())])
_REPEATED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("tokens", pa.binary()), ("hot", pa.binary()), ("n_hot", pa.int64())])
_CELLS = pa.schema(
    [
        ("bucket", pa.int64()),
        ("block", pa.int64()),
        ("document", pa.binary()),
        ("several", pa.binary()),
        ("count", pa.binary()),
        ("content", pa.binary()),
    ]
)
_FOUND = pa.schema(
    [
        ("block", pa.int64()),
        ("token", pa.binary()),
        ("hash", pa.binary()),
        ("first", pa.binary()),
        ("last", pa.binary()),
        ("document", pa.binary()),
    ]
)
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema):
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of the block that they are written in."""
    block = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([block] * batch.num_rows, pa.int64()), batch.column("text")], schema=_BLOCKS
        )


def _by_block(batches):
    """(block, document ids, texts), each a bounded part of a block."""
    for batch in slices(batches, "text"):
        blocks = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            ids = np.array([_NO_ID if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
            yield int(blocks[a]), ids, part.column("text").to_pylist()


def _entries(folder, block) -> pa.Table | None:
    """What the table in ``folder`` has for a block."""
    files, place = filesystem(f"{folder}/block={block}")
    if files.get_file_info(place).type == pa.fs.FileType.NotFound:
        return None
    return pa.parquet.read_table(place, filesystem=files, partitioning=None)


def _emit_tokens(splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block, tokens):
            tokens, counts = np.unique(np.concatenate(tokens), return_counts=True)
            bucket = np.searchsorted(splitters, tokens, "right")
            rows = []
            for k in np.unique(bucket).tolist():
                own = bucket == k
                once, more = own & (counts == 1), own & (counts > 1)
                arrays = (_short(tokens[once]), _short(tokens[more]), counts[more].astype(np.uint32))
                rows.append((k, block, *(a.tobytes() for a in arrays)))
            return record_batch(rows, _TOKENS)

        at, held = None, []
        for block, _, texts in _by_block(batches):
            if block != at and held:
                yield out(at, held)
                held = []
            at = block
            held += [c.token for c in cells_of(texts)]
        if held:
            yield out(at, held)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """The tokens of a bucket that occur twice, for each block that has them; those of many cells, and how many, apart."""
    bucket, rows, all_, times = group.column("bucket")[0].as_py(), [], [], []
    for block, once, more, n in zip(*(group.column(c).to_pylist() for c in ("block", "once", "more", "times")), strict=True):
        once = np.frombuffer(once, np.uint32)
        all_.append(np.concatenate([once, np.frombuffer(more, np.uint32)]))
        times.append(np.concatenate([np.ones(len(once), np.uint32), np.frombuffer(n, np.uint32)]))
        rows.append(block)
    values, counts = np.concatenate(all_), np.concatenate(times)
    order = np.argsort(values)
    starts = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    values, counts = values[order][starts], np.add.reduceat(counts[order], starts, dtype=np.int64)
    twice, hot, out = values[counts > 1], values[counts > HOT_CELLS], []
    for block, own, n in zip(rows, all_, times, strict=True):
        many = np.isin(own, hot)
        out.append((block, bucket, own[np.isin(own, twice)].tobytes(), own[many].tobytes(), int(n[many].sum())))
    out = [row for row in out if row[2]]
    return pa.Table.from_batches([record_batch(out, _REPEATED)] if out else [], schema=_REPEATED)


def _keys(bucket, short):
    return bucket.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64)


def _known(values, wanted):
    """Which of ``values`` are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def _token_keys(table, name):
    """The sorted keys of the tokens that ``_repeated`` lists for a block under ``name``."""
    parts = zip(table.column("bucket").to_pylist(), table.column(name).to_pylist(), strict=True)
    return np.sort(np.concatenate([_keys(np.uint64(b), np.frombuffer(t, np.uint32)) for b, t in parts]))


def _cut_hot(cells, splitters, hot):
    """Cuts the cells of the ``hot`` tokens into windows."""
    if len(hot):
        cells.cut(_known(_keys(np.searchsorted(splitters, cells.token, "right"), _short(cells.token)), hot))


def _emit_cells(splitters, folder, n_hot):
    """The cells of repeated tokens; windows of hot tokens go to ``n_hot`` more buckets, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block, held):
            token, hash_, document, count = (np.concatenate(c) for c in list(zip(*held, strict=True))[:4])
            is_hot = np.concatenate([h[4] for h in held])
            content = [c for h in held for c in h[5]]
            order = np.lexsort((document, hash_, token))
            new = np.append(True, (token[order][1:] != token[order][:-1]) | (hash_[order][1:] != hash_[order][:-1]))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order)) - 1
            least = order[starts]
            several = document[order[ends]] != document[least]
            dealt = (hash_[least] % np.uint64(max(1, n_hot))).astype(np.int64) + len(splitters) + 1
            bucket = np.where(is_hot[least], dealt, np.searchsorted(splitters, token[least], "right"))
            rows = []
            for k in np.unique(bucket).tolist():
                own = least[bucket == k]
                arrays = (document[own], several[bucket == k].astype(np.uint8), count[own].astype(np.uint8))
                rows.append((k, block, *(a.tobytes() for a in arrays), b"".join([content[i] for i in own.tolist()])))
            return record_batch(rows, _CELLS)

        at, wanted, hot, held, size = None, None, None, [], 0
        for block, ids, texts in _by_block(batches):
            if held and (block != at or size > HELD):
                yield out(at, held)
                held, size = [], 0
            if block != at:
                at, wanted, table = block, None, _entries(folder, block)
                if table is not None:
                    wanted, hot = _token_keys(table, "tokens"), _token_keys(table, "hot")
            for c in cells_of(texts) if wanted is not None else ():
                _cut_hot(c, splitters, hot)
                key = _keys(np.searchsorted(splitters, c.token, "right"), _short(c.token))
                own = np.flatnonzero(_known(key, wanted))
                for own in np.split(own, range(HELD, len(own), HELD)) if len(own) else ():
                    content = [c.content(i) for i in own]
                    held.append((c.token[own], c.hash[own], ids[c.text[own]], c.count[own], _known(key[own], hot), content))
                    size += len(own)
                    if size > HELD:
                        yield out(at, held)
                        held, size = [], 0
        if held:
            yield out(at, held)

    return run


def _keys_of(data, begin, count):
    """Tokens and hashes of cells from their bytes, a bounded number at a time."""
    token, hash_ = np.empty(len(begin), np.uint64), np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), 5000):
        b = min(a + 5000, len(begin))
        part = np.frombuffer(data, np.uint8)[begin[a] : begin[b - 1] + count[b - 1] + SPAN - 1]
        token[a:b], hash_[a:b] = _cell_keys(*window_hashes(part), begin[a:b] - begin[a], count[a:b])
    return token, hash_


def _parts(group, count):
    """Slices of cells with whole groups, each of little more than ``SORTED_WINDOWS`` windows."""
    if not len(group):
        return
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    number = (np.cumsum(count) - count)[starts] // SORTED_WINDOWS
    cuts = [*starts[np.append(True, number[1:] != number[:-1])].tolist(), len(group)]
    yield from map(slice, cuts, cuts[1:])


def _resolve(group: pa.Table) -> pa.Table:
    """The smallest documents of the windows of a bucket, for each block that has a larger one with them."""
    def read(name, kind):
        return np.concatenate([np.frombuffer(v, kind) for v in group.column(name).to_pylist()])

    document = read("document", np.int64)
    several, count = read("several", np.uint8).astype(bool), read("count", np.uint8).astype(np.int64)
    block = np.repeat(np.asarray(group.column("block")), [len(v) for v in group.column("several").to_pylist()])
    data = b"".join(group.column("content").to_pylist())
    begin = np.cumsum(count + SPAN - 1) - (count + SPAN - 1)
    token, hash_ = _keys_of(data, begin, count)

    order = np.lexsort((document, hash_, token))
    fresh_token = np.append(True, token[order][1:] != token[order][:-1])
    fresh = fresh_token | np.append(True, hash_[order][1:] != hash_[order][:-1])
    cell = np.empty(len(order), np.int64)  # number of the distinct cell of each entry
    cell[order] = _runs(fresh)
    sample = order[fresh]  # the entry with the smallest document of each distinct cell
    group_of = _runs(fresh_token)[fresh]
    mixed = np.flatnonzero(np.bincount(group_of)[group_of] > 1)
    alone = np.flatnonzero(np.bincount(group_of)[group_of] == 1)

    runs = [(alone, np.zeros(len(alone), np.int64), count[sample[alone]] - 1, document[sample[alone]])]
    for part in _parts(group_of[mixed], count[sample[mixed]]):
        part = mixed[part]
        content = [data[begin[i] : begin[i] + count[i] + SPAN - 1] for i in sample[part].tolist()]
        own, first, last, least = smallest_documents(content, group_of[part], document[sample[part]])
        runs.append((part[own], first, last, least))
    run_cell, first, last, least = (np.concatenate(c) for c in zip(*runs, strict=True))
    by_cell = np.argsort(run_cell, kind="stable")
    run_cell, first, last, least = run_cell[by_cell], first[by_cell], last[by_cell], least[by_cell]
    at, to = np.searchsorted(run_cell, cell, "left"), np.searchsorted(run_cell, cell, "right")
    entry = np.repeat(np.arange(len(cell)), to - at)
    run = np.arange(len(entry)) - np.repeat(np.cumsum(to - at) - (to - at), to - at) + np.repeat(at, to - at)
    useful = (least[run] < document[entry]) | several[entry]
    entry, run = entry[useful], run[useful]
    rows = []
    by_block = np.argsort(block[entry], kind="stable")
    entry, run = entry[by_block], run[by_block]
    cuts = np.flatnonzero(np.append(True, block[entry][1:] != block[entry][:-1])) if len(entry) else []
    for a, b in zip(cuts, [*cuts[1:], len(entry)], strict=True):
        e, r = entry[a:b], run[a:b]
        arrays = (token[e], hash_[e], first[r].astype(np.uint8), last[r].astype(np.uint8), least[r])
        rows.append((int(block[e[0]]), *(x.tobytes() for x in arrays)))
    return pa.Table.from_batches([record_batch(rows, _FOUND)] if rows else [], schema=_FOUND)


class _Found:
    """What is known of the windows of a block, by cell."""

    def __init__(self, table):
        def read(name, kind):
            return np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()])

        token, key = read("token", np.uint64), _mix(read("token", np.uint64), read("hash", np.uint64))
        order = np.argsort(key, kind="stable")
        self.key, self.token = key[order], token[order]
        self.first, self.last = read("first", np.uint8)[order].astype(np.int64), read("last", np.uint8)[order].astype(np.int64)
        self.document = read("document", np.int64)[order]

    def removed(self, cells: Cells, ids):
        """(text, first byte, byte after) of what a smaller document has."""
        key = _mix(cells.token, cells.hash)
        at, to = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = to - at
        cell = np.repeat(np.arange(len(key)), n)
        run = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
        text = cells.text[cell]
        good = (self.token[run] == cells.token[cell]) & (self.document[run] < ids[text])
        cell, run, text = cell[good], run[good], text[good]
        start = cells.start[cell]
        return text, start + self.first[run], start + self.last[run] + SPAN


def _remove(splitters, repeated, folder, with_kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, hot = None, None, None
        for block, ids, texts in _by_block(batches):
            if block != at:
                at, table = block, _entries(folder, block)
                found = None if table is None else _Found(table)
                hot = None if table is None else _token_keys(_entries(repeated, block), "hot")
            sizes = np.array([len(t) for t in texts])
            begins = np.cumsum(sizes + 1) - (sizes + 1)  # a byte between two texts keeps their spans apart
            steps = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
            for cells in cells_of(texts) if found is not None else ():
                _cut_hot(cells, splitters, hot)
                text, start, end = found.removed(cells, ids)
                np.add.at(steps, begins[text] + start, 1)
                np.add.at(steps, begins[text] + end, -1)
            gone, rows = np.cumsum(steps) > 0, []
            for text, begin, doc_id in zip(texts, begins.tolist(), ids.tolist(), strict=True):
                own, kept = gone[begin : begin + len(text)], text
                n = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                if n:
                    kept = np.frombuffer(text, np.uint8)[~own].tobytes()
                doc_id = None if doc_id == _NO_ID else doc_id
                rows.append((doc_id, len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            yield record_batch(rows, _RESULT)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        for cells in cells_of(batch.column("text").to_pylist()):
            few = max(1, SAMPLED_TOKENS * batch.num_rows)
            step = max(1, len(cells.token) // few)
            yield pa.RecordBatch.from_arrays([pa.array(cells.token[::step].view(np.int64))], ["token"])


def sampled_splitters(texts: DataFrame, n_texts, n_buckets) -> np.ndarray:
    """Tokens that deal the cells to ``n_buckets`` ranges of about one size."""
    share = min(1.0, SAMPLED_DOCUMENTS / max(1, n_texts))
    tokens = texts.select("text").sample(share, 5).mapInArrow(_sampled, "token long").toArrow()
    tokens = np.sort(np.asarray(tokens.column("token").combine_chunks()).view(np.uint64))
    if not len(tokens):
        return np.empty(0, np.uint64)
    return np.unique(tokens[np.arange(1, n_buckets) * len(tokens) // n_buckets])


def _keyed(df, name):
    """Writes a table by block and returns its folder."""
    folder = stage_path(df.sparkSession, name)
    df.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def repeated_cells(blocks: DataFrame, splitters):
    """The cells of repeated tokens by bucket, and the folder that names these tokens by block."""
    tokens = blocks.mapInArrow(_emit_tokens(splitters), _ddl(_TOKENS))
    repeated = _keyed(tokens.groupBy("bucket").applyInArrow(_repeated, _ddl(_REPEATED)), "repeated")
    n_hot = blocks.sparkSession.read.schema("n_hot long").parquet(repeated).agg(F.sum("n_hot")).first()[0] or 0
    cells = blocks.mapInArrow(_emit_cells(splitters, repeated, -(-n_hot * REACH // HOT_WINDOWS)), _ddl(_CELLS))
    return cells, repeated


def drop_repeated_passages(docs: DataFrame, texts=False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with ``texts``) the kept bytes, per row of ``docs``.

    A byte goes if a string of ``SPAN`` bytes that covers it also starts in a
    document with a smaller doc_id. Whole texts are compared as UTF-8 bytes,
    NULL as an empty one; a match never crosses documents. Rows under one
    doc_id do not remove each other's bytes; a row without one is larger than
    all others, and such rows do not remove each other's either. Texts shorter
    than ``SPAN`` stay. An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    blocks = stage(rows.mapInArrow(_number, _ddl(_BLOCKS)), "blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # more buckets than partitions, since they are dealt out by a hash
    n_buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // BUCKET_BYTES))
    splitters = sampled_splitters(blocks, size["n"], n_buckets)

    cells, repeated = repeated_cells(blocks, splitters)
    found = _keyed(cells.groupBy("bucket").applyInArrow(_resolve, _ddl(_FOUND)), "found")
    result = blocks.mapInArrow(_remove(splitters, repeated, found, texts), _ddl(_RESULT))
    return result if texts else result.drop("kept")
