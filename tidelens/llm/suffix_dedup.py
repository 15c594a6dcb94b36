"""Suffix-array dedup: bytes go that a string of `width` bytes covers which also starts in a document with a smaller doc_id.

A suffix is sorted for anchors, not for every byte. The anchor of a window of `width` bytes is where the smallest of its hashed
KEY-byte strings starts (the leftmost of equals). Equal windows have equal anchors, so whatever two documents share is found among suffixes
that begin with the same KEY bytes. The windows of one anchor are one run of bytes, its segment, which carries all that any comparison of them needs.

Splitters are drawn from a sample of anchors and range-partition the suffixes by their leading KEY bytes. A bucket sorts its
suffixes by multikey quicksort, eight bytes a key: first by the leading bytes, then, where these are alike, the windows at each distance from
the anchor, going on only where neighbours still agree. Neighbours that agree in all `width` bytes are one group, and its smallest doc_id is the source.
Equal leading bytes are never parted by a splitter, so two suffixes on different sides of a boundary differ in their first KEY bytes. Only a key that
takes up several splitters is dealt to several buckets: its segments are cut by the distance of a window from its anchor, which equal windows share.
So comparing across boundaries has nothing left to find.

Segments that a task meets again with a greater doc_id are judged there, byte by byte, and not sent: a passage that stands everywhere
reaches its bucket a few times from each task.

Defined cases: a null text is empty. A text of fewer than `width` bytes has no window. Rows with a null doc_id are kept as they are and are no source
for others. Rows that share a doc_id are versions of one document: they are no source for one another, and a byte position that goes in one goes in all.
A very long text is a chunk by itself, held in memory whole. Extra columns are ignored, or stay as they are where the result has the columns of docs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm._spark import MANY_TASKS, parts, stable, text_bytes
from tidelens.llm._text import Chunk, chunks, mix, planes, ragged, unplanes

#: Bytes in a window, and bytes that a suffix is dealt by.
WIDTH, KEY = 50, 12
#: Bytes of text that one step looks for anchors in: its arrays fit a core's cache.
STEP = 1 << 18
#: Bytes of text whose segments are sent together.
SENT_BYTES = 16 << 20
#: Bytes of segments that a bucket should hold. Segments are about four times the text.
BUCKET_BYTES, GROWTH = 24 << 20, 4
#: Bytes of texts, on average, that splitters are drawn from, and anchors drawn for each splitter.
SAMPLE_BYTES, DRAWN = 64 << 20, 16
#: Segments that a task remembers: some 120 bytes each.
SLOTS = 1 << 15
#: Windows that a bucket sorts at once. A single key with more is taken one distance at a time.
WINDOWS = 1 << 21

_MARKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_SENT = "bucket int, block long, count long, data binary, lengths binary, ahead binary, docs binary, starts binary"
_FOUND = "block long, count long, docs binary, starts binary, lengths binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SENT_SCHEMA, _FOUND_SCHEMA = (pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in x.split(", "))]) for x in (_SENT, _FOUND))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; `data` ends with seven spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,)).astype(np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of every segment of the texts that `offsets` cuts `data` into."""
    n, span = len(data), width - key + 1
    inside = np.ones(n, bool)
    tail = np.minimum(np.diff(offsets), width - 1)
    inside[ragged(offsets[1:] - tail, tail)] = False
    out = []
    for at in range(0, n, STEP):
        own = data[at : at + STEP + width]
        m = len(own) - key + 1
        if m < span:
            break
        words = _words(np.append(own, np.zeros(7, np.uint8)))
        codes = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        for skip in range(8, key, 8):
            codes = mix(codes) + words[min(skip, key - 8) :][:m]
        # The place in the low bits: the smallest is the leftmost of equals, and says where it is.
        low = (mix(codes) & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
        have = 1
        while have < span:
            more = min(have, span - have)
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        place = (low[:STEP] & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = inside[at : at + len(place)]
        place = place[: len(ok)]
        joins = ok[1:] & ok[:-1] & (place[1:] == place[:-1])
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~joins
        last[:-1] &= ~joins
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        out.append((first + at, last + at, place[first] + at))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    first, last, anchor = (np.concatenate(x) for x in zip(*out))
    return first, last, anchor


def _matrix(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, ahead: np.ndarray, most: int) -> np.ndarray:
    """Every segment as a row of numbers: its length and its bytes ahead of the anchor, then its bytes, zero beyond its end."""
    n = -(-most // 8)
    padded = np.append(data, np.zeros(8 * n + 8, np.uint8))
    out = np.empty((len(first), n + 1), np.uint64)
    out[:, 0] = lengths << 32 | ahead
    for at in range(0, len(first), 1 << 15):
        own = slice(at, at + (1 << 15))
        low, high = int(first[own].min()), int(first[own].max())
        words = _words(padded[low : high + 8 * n + 8])
        for j in range(n):
            out[own, j + 1] = words[first[own] - low + 8 * j] & _MARKS[np.clip(lengths[own] - 8 * j, 0, 8)]
    return out


def _digest(rows: np.ndarray) -> np.ndarray:
    code = mix(rows[:, 0] + np.uint64(1))
    for j in range(1, rows.shape[1]):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return code


class Seen:
    """Segments that a task has sent, in a table of a fixed size: one a slot, where a segment that was met again since stays."""

    def __init__(self, words: int, slots: int = SLOTS):
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.codes, self.docs, self.met = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int8)
        self.rows = np.zeros((slots, words), np.uint64)

    def later(self, codes: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which segments were sent before with a smaller doc_id; others are remembered, as far as there is room."""
        slot = (codes >> self.shift).astype(np.int64)
        same = (self.codes[slot] == codes) & (self.met[slot] > 0)
        same[same] = (self.rows[slot[same]] == rows[same]).all(axis=1)
        later = same & (self.docs[slot] < docs)
        held = ~same & (self.met[slot] > 1)
        self.met[slot[held]] = 1
        self.met[slot[same]] = 2
        new = np.flatnonzero(~later & ~held)
        new = new[np.unique(slot[new], return_index=True)[1]]  # one a slot
        at = slot[new]
        self.met[at[~same[new]]] = 1
        self.codes[at], self.docs[at], self.rows[at] = codes[new], docs[new], rows[new]
        return later


def _repeats(codes: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which segments stand among the given ones with a smaller doc_id too."""
    order = np.lexsort((docs, codes))
    codes, docs, rows = codes[order], docs[order], rows[order]
    new = np.append(True, codes[1:] != codes[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    later = docs > docs[leader]
    later[later] = (rows[later] == rows[leader[later]]).all(axis=1)
    out = np.zeros(len(codes), bool)
    out[order] = later
    return out


def _keys(data: np.ndarray, places: np.ndarray, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight of the key bytes at each place, as numbers that sort as the bytes do."""
    view = np.ndarray((max(0, len(data) - 7),), ">u8", data.tobytes(), 0, (1,))
    return view[places].astype(np.uint64), view[places + key - 8].astype(np.uint64)


def _ranks(splits: np.ndarray, high: np.ndarray, low: np.ndarray, right: bool) -> np.ndarray:
    """How many of the sorted splitters lie below each key, or not above it if `right`."""
    first, stop = (np.searchsorted(splits[:, 0], high, side) for side in ("left", "right"))
    some = np.flatnonzero(first < stop)
    a, b, own = first[some], stop[some], low[some]
    while (open_ := a < b).any():
        middle = np.minimum((a + b) // 2, len(splits) - 1)
        above = open_ & ((splits[middle, 1] <= own) if right else (splits[middle, 1] < own))
        b = np.where(open_ & ~above, middle, b)
        a = np.where(above, middle + 1, a)
    first[some] = a
    return first


def _deal(splits: np.ndarray, high: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, span: int):
    """Index, first window, last window and bucket of the segments. Those whose key is several splitters are cut by their windows' distance from the anchor."""
    bucket = _ranks(splits, high, low, True)
    below = _ranks(splits, high, low, False)
    ties = np.minimum(bucket - below, span)
    some = np.flatnonzero(ties > 1)
    if not len(some):
        return np.arange(len(first)), first, last, bucket
    rest = np.flatnonzero(ties <= 1)
    cut = [(rest, first[rest], last[rest], bucket[rest])]
    for part in range(int(ties.max())):
        own = some[ties[some] > part]
        step = -(-span // ties[own])
        a = np.maximum(first[own], anchor[own] - np.minimum((part + 1) * step, span) + 1)
        b = np.minimum(last[own], anchor[own] - part * step)
        has = a <= b
        cut.append((own[has], a[has], b[has], below[own[has]] + 1 + part))
    index, first, last, bucket = (np.concatenate(x) for x in zip(*cut))
    return index, first, last, bucket


def _segments(chunk: Chunk, width: int, key: int):
    """Of a chunk: doc_ids, rows' starts, first windows, last windows and anchors; texts of rows without a doc_id aren't looked at."""
    first, last, anchor = anchors(chunk.data, chunk.offsets, width, key)
    ids = chunk.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.searchsorted(chunk.offsets, first, "right") - 1
    return ids[row], chunk.offsets[row], first, last, anchor


class _Parcels:
    """What a task sends to buckets, packed and compressed bucket by bucket."""

    def __init__(self):
        self.codec = pa.Codec("zstd", 3)
        self.held: list[tuple] = []

    def add(self, sent: bool, bucket: np.ndarray, docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ahead: np.ndarray, data: np.ndarray) -> None:
        if len(bucket):
            self.held.append((np.full(len(bucket), sent), bucket, docs, starts, lengths, ahead, data))

    def _pack(self, x: np.ndarray | bytes) -> bytes:
        return self.codec.compress(x if isinstance(x, bytes) else x.tobytes(), asbytes=True)

    def close(self, block: int) -> pa.RecordBatch:
        sent, bucket, docs, starts, lengths, ahead, data = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        size = np.where(sent, lengths, 0)
        froms = np.cumsum(size) - size
        order = np.lexsort((starts, docs, sent, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order] * 2 + sent[order], prepend=-1, append=-1))
        rows = {c: [] for c in _SENT_SCHEMA.names}
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            rows["bucket"].append(int(bucket[own[0]]))
            rows["block"].append(block)
            rows["count"].append(len(own))
            rows["data"].append(self._pack(data[ragged(froms[own], lengths[own])]) if sent[own[0]] else None)
            rows["lengths"].append(self._pack(lengths[own].astype("<u2")))
            rows["ahead"].append(self._pack(ahead[own].astype("<u2")))
            rows["docs"].append(self._pack(planes(docs[own])))
            rows["starts"].append(self._pack(planes(starts[own], 5)))
        return pa.RecordBatch.from_pydict(rows, schema=_SENT_SCHEMA)


def _send(width: int, key: int, splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 2 * width - key
        task, seen, parcels, size, number = TaskContext.get().partitionId(), Seen(-(-most // 8) + 1), _Parcels(), 0, 0
        for chunk in chunks(batches):
            docs, begins, first, last, anchor = _segments(chunk, width, key)
            if len(first):
                index, first, last, bucket = _deal(splits, *_keys(chunk.data, anchor, key), first, last, anchor, width - key + 1)
                docs, starts, ahead, lengths = docs[index], first - begins[index], anchor[index] - first, last - first + width
                rows = _matrix(chunk.data, first, lengths, ahead, most)
                codes = _digest(rows)
                later = _repeats(codes, docs, rows)
                new = np.flatnonzero(~later)
                later[new[seen.later(codes[new], docs[new], rows[new])]] = True
                for sent, own in ((True, np.flatnonzero(~later)), (False, np.flatnonzero(later))):
                    data = chunk.data[ragged(first[own], lengths[own])] if sent else chunk.data[:0]
                    parcels.add(sent, bucket[own], docs[own], starts[own], lengths[own], ahead[own], data)
            size += len(chunk.data)
            if size >= SENT_BYTES and parcels.held:  # what a block says of a segment goes where the segment goes, so a task that runs again may cut blocks differently
                yield parcels.close((task << 24) + number)
                size, number = 0, number + 1
        if parcels.held:
            yield parcels.close((task << 24) + number)

    return run


def _ties(order: np.ndarray, group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of multikey quicksort: `order`, grouped by the sorted `group`, sorted by `word` within groups; only what still has an equal neighbour is left."""
    if not len(order):
        return order, group
    first = np.append(True, group[1:] != group[:-1])
    leader = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    if (word == word[leader]).all():
        return order, group
    by = np.argsort(word)
    by = by[np.argsort(group[by], kind="stable")]
    order, group, word = order[by], group[by], word[by]
    new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
    alone = new & np.append(new[1:], True)
    group = np.cumsum(new)[~alone]
    return order[~alone], _small(group)


def _small(group: np.ndarray) -> np.ndarray:
    """Sorted group numbers, from 0 without gaps, in the smallest type (two bytes are sorted by counting)."""
    if not len(group):
        return group.astype(np.uint16)
    group = np.cumsum(np.append(0, group[1:] != group[:-1]))
    return group.astype(np.uint16 if group[-1] < 1 << 16 else np.int32)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, ahead: np.ndarray, docs: np.ndarray, width: int = WIDTH, key: int = KEY, most: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Segment and window (its place in the segment) of all windows of a bucket that stand in a segment of a smaller doc_id too, sorted."""
    span = width - key + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    view = np.ndarray((len(data) + 1,), ">u8", padded.tobytes(), 0, (1,))
    anchor, counts = offsets[:-1] + ahead, np.diff(offsets) - width + 1
    order, group = np.arange(len(anchor)), np.zeros(len(anchor), np.uint16)
    for skip in (*range(0, key - 8, 8), key - 8):
        order, group = _ties(order, group, view[anchor[order] + skip].astype(np.uint64))
    found, half = [], span // 2
    # Windows that begin up to half the way before the anchor share more bytes after it, the others more bytes before it.
    for distances, first, stop in ((range(half), 0, width - half + 1), (range(half, span), -half, key)):
        has = (ahead - counts + 1 < distances.stop) & (ahead >= distances.start)
        own, alike = _several(group[has[order]])
        own = order[has[order]][own]
        for skip in (*range(first, stop - 8, 8), stop - 8):
            own, alike = _ties(own, alike, view[anchor[own] + skip].astype(np.uint64))
        if len(own):
            found += _by_class(view, offsets, anchor, ahead, counts, docs, own, alike, distances, width, most)
    if not found:
        return order[:0], order[:0]
    segment, window = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((window, segment))
    return segment[by], window[by]


def _by_class(view, offsets, anchor, ahead, counts, docs, order, group, distances: range, width: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """_alike() for all segments, which `group` sorts into classes, about `most` windows at once."""
    cuts, span = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1, append=-1)), len(distances)
    # Classes with a single document have nothing to be compared with.
    own = docs[order]
    mixed = np.minimum.reduceat(own, cuts[:-1]) != np.maximum.reduceat(own, cuts[:-1])
    begins, sizes = cuts[:-1][mixed], np.diff(cuts)[mixed]
    total, at, found = np.append(0, np.cumsum(sizes)), 0, []
    while at < len(begins):
        upto = max(at + 1, min(at + (1 << 16) // span, int(np.searchsorted(total, total[at] + most // span, "right")) - 1))
        members = order[ragged(begins[at:upto], sizes[at:upto])]
        number = np.repeat(np.arange(upto - at), sizes[at:upto])
        for part in [range(d, d + 1) for d in distances] if len(members) * span > most else [distances]:
            found.append(_alike(view, offsets, anchor, ahead, counts, docs, members, number, part, width))
        at = upto
    return found


def _alike(view, offsets, anchor, ahead, counts, docs, members, number, distances: range, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the segments `members`, grouped by `number`, windows that start at `distances` before their anchor and repeat one of a smaller doc_id."""
    low = np.maximum(distances[0], ahead[members] - counts[members] + 1)
    high = np.minimum(distances[-1], ahead[members])
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(members)), n)
    far = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    group = number[row] * len(distances) + (far - distances[0])
    by = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
    group = group[by]
    segment, place = members[row[by]], anchor[members[row[by]]] - far[by]
    order, group = _several(group)
    for skip in (*range(0, width - 8, 8), width - 8):
        if not len(order):
            break
        order, group = _ties(order, group, view[place[order] + skip].astype(np.uint64))
    if not len(order):
        return order, order
    own = docs[segment[order]]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(own, cuts)
    later = order[own > np.repeat(least, np.diff(np.append(cuts, len(order))))]
    return segment[later], place[later] - offsets[segment[later]]


def _several(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of sorted groups that have more than one row, and their groups."""
    new = np.append(True, group[1:] != group[:-1])[: len(group)]
    alone = new & np.append(new[1:], True)[: len(group)]
    return np.flatnonzero(~alone), _small(group[~alone])


def _runs(docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by document and start, with those merged that overlap or touch."""
    order = np.lexsort((starts, docs))
    docs, starts, lengths = docs[order], starts[order], lengths[order]
    ends = starts + lengths
    new = np.append(True, docs[1:] != docs[:-1])
    # The furthest end so far, document by document: a document's number lifts its ends above all earlier ones.
    lift = (np.cumsum(new) - 1) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + lift)
    new[1:] |= starts[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], starts[first], reach[last] - lift[last] - starts[first]


def _compare(width: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], schema=_SENT_SCHEMA)
        codec = pa.Codec("zstd", 3)
        unpack = lambda x, size: codec.decompress(x, size, asbytes=True)
        counts, blocks = (table.column(c).to_pylist() for c in ("count", "block"))
        lengths = [np.frombuffer(unpack(x, 2 * n), "<u2").astype(np.int64) for x, n in zip(table.column("lengths").to_pylist(), counts)]
        docs = [unplanes(unpack(x, 8 * n)) for x, n in zip(table.column("docs").to_pylist(), counts)]
        starts = [unplanes(unpack(x, 5 * n), 5) for x, n in zip(table.column("starts").to_pylist(), counts)]
        data, ahead = table.column("data").to_pylist(), table.column("ahead").to_pylist()
        sent = [i for i, x in enumerate(data) if x is not None]
        found = {i: (docs[i], starts[i], lengths[i]) for i, x in enumerate(data) if x is None}
        del table
        if sent:
            raw = np.frombuffer(b"".join(unpack(data[i], int(lengths[i].sum())) for i in sent), np.uint8)
            data.clear()
            own = np.concatenate([lengths[i] for i in sent])
            before = np.concatenate([np.frombuffer(unpack(ahead[i], 2 * counts[i]), "<u2") for i in sent]).astype(np.int64)
            ids, at = np.concatenate([docs[i] for i in sent]), np.concatenate([starts[i] for i in sent])
            segment, window = repeated_windows(raw, np.append(0, np.cumsum(own)), before, ids, width, key)
            piece = np.repeat(sent, [counts[i] for i in sent])[segment]
            ids, at = ids[segment], at[segment] + window
            for i in np.unique(piece).tolist():
                a, b = np.searchsorted(piece, [i, i + 1])
                found[i] = (ids[a:b], at[a:b], np.full(b - a, width))
        rows = {c: [] for c in _FOUND_SCHEMA.names}
        for i, spans in found.items():
            ids, at, size = _runs(*spans)
            rows["block"].append(blocks[i])
            rows["count"].append(len(ids))
            for name, x in (("docs", planes(ids)), ("starts", planes(at, 5)), ("lengths", planes(size, 5))):
                rows[name].append(codec.compress(x, asbytes=True))
        if found:
            yield pa.RecordBatch.from_pydict(rows, schema=_FOUND_SCHEMA)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The spans of one block's documents, one row a document."""
    codec, counts = pa.Codec("zstd", 3), table.column("count").to_pylist()
    of = lambda name, width: np.concatenate([unplanes(codec.decompress(x, width * n, asbytes=True), width) for x, n in zip(table.column(name).to_pylist(), counts)])
    docs, starts, lengths = _runs(of("docs", 8), of("starts", 5), of("lengths", 5))
    cuts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(starts + lengths, pa.int64())], names=["first", "stop"])
    return pa.table({"doc_id": pa.array(docs[cuts]), "spans": pa.ListArray.from_arrays(pa.array(np.append(cuts, len(docs)), pa.int32()), spans)})


def _draw(width: int, key: int, share: float):
    """Leading bytes of a sample of anchors and a digest of their segments, by which copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 2 * width - key
        for chunk in chunks(batches):
            _, _, first, last, anchor = _segments(chunk, width, key)
            if not len(first):
                continue
            lengths = last - first + width
            codes = _digest(_matrix(chunk.data, first, lengths, anchor - first, most))
            some = np.flatnonzero(codes < np.uint64(min(share, 1.0) * ((1 << 64) - 2048)))
            high, low = _keys(chunk.data, anchor[some], key)
            yield pa.RecordBatch.from_pydict({"high": high.view(np.int64), "low": low.view(np.int64), "code": codes[some].view(np.int64)})

    return run


def splitters(docs: DataFrame, buckets: int, total: int, width: int = WIDTH, key: int = KEY) -> np.ndarray:
    """buckets - 1 sorted keys, as pairs of numbers, that part the suffixes of a sample evenly. A key that stands in the sample more often is repeated."""
    if buckets == 1:
        return np.zeros((0, 2), np.uint64)
    for bytes_read in (SAMPLE_BYTES, total):
        fraction = min(1.0, bytes_read / total)
        share = DRAWN * buckets * 17 / (fraction * total)
        some = docs.sample(fraction, 42) if fraction < 1 else docs
        drawn = some.mapInArrow(_draw(width, key, share), "high long, low long, code long").distinct().toPandas()
        if len(drawn) >= buckets or fraction == 1:
            break
    high, low = (drawn[c].to_numpy().view(np.uint64) for c in ("high", "low"))
    order = np.lexsort((low, high))
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    return np.stack([high[at], low[at]], axis=1)


def repeated_spans(docs: DataFrame, width: int = WIDTH, key: int = KEY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id and spans (first, stop): the byte intervals of every document that repeat strings of smaller doc_ids, one row for each document that has any."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    total = text_bytes(docs)
    buckets = parts(total * GROWTH, max(bucket_bytes, total * GROWTH / MANY_TASKS))
    splits = splitters(docs, buckets, total, width, key)
    sent = docs.mapInArrow(_send(width, key, splits), _SENT)
    found = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_compare(width, key), _FOUND)
    merged = found.groupBy("block").applyInArrow(_merge, "doc_id long, spans array<struct<first: long, stop: long>>")
    return merged.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(at: str, digest: bool, whole_too: bool):
    """What is kept of the texts in column `at`, without the intervals in column `spans`; all other columns pass, and the text if whole_too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, at):
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            spans = chunk.column("spans")
            lists = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
            row = np.repeat(np.arange(chunk.rows), lists)
            if len(row):
                flat, base, size = spans.flatten(), chunk.offsets[row], np.diff(chunk.offsets)[row]
                np.add.at(edge, base + np.minimum(flat.field("first").to_numpy(), size), 1)
                np.add.at(edge, base + np.minimum(flat.field("stop").to_numpy(), size), -1)
            keep = np.cumsum(edge[:-1], dtype=np.int32) == 0
            begin = ~keep
            begin[1:] &= keep[:-1]
            inner = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
            begin[inner] = ~keep[inner]
            left = np.append(0, np.cumsum(keep))[chunk.offsets]
            runs = np.diff(np.append(0, np.cumsum(begin))[chunk.offsets])
            raw = chunk.data[keep].tobytes()
            kept = [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
            sizes = np.diff(chunk.offsets)
            out = {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(sizes - np.diff(left), pa.int64()), "n_spans": pa.array(runs, pa.int64())}
            out["kept"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict({c: chunk.column(c) for c in chunk.batch.schema.names if c != "spans" and (whole_too or c != at)} | out)

    return run


def _cut_out(docs: DataFrame, width: int, key: int, digest: bool, bucket_bytes: int) -> DataFrame:
    """The columns of docs as c0, c1 and so on (without the text if digest), n_bytes, n_removed, n_spans and kept (the bytes, or their digest)."""
    names = docs.columns
    id_, at = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    spans = stable(repeated_spans(docs, width, key, bucket_bytes).select(F.col("doc_id").alias("to"), "spans", F.lit(True).alias("known")))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*[f for f in plain.schema.fields if not digest or f.name != at], *T._parse_datatype_string(f"n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}").fields])
    # Rows without a doc_id find nothing, and are spread by their texts.
    own = plain.withColumn("to", F.coalesce(id_, F.xxhash64(at))).withColumn("known", F.col(id_).isNotNull())
    found = own.join(spans, ["to", "known"], "left").select(*plain.columns, "spans")
    return found.mapInArrow(_cut(at, digest, not digest), schema)


def digests(docs: DataFrame, width: int = WIDTH, key: int = KEY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    found = _cut_out(docs.select("doc_id", "text"), width, key, True, bucket_bytes)
    return found.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: int = KEY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs, n_bytes, n_removed, n_spans and kept_bytes: what is left of every text, as bytes, for a cut may part a character.

    These four take the place of columns of docs that have their names.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes")
    found = _cut_out(docs, width, key, False, bucket_bytes)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_bytes"))
