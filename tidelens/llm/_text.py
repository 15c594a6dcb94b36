"""Numpy helpers that run inside Spark tasks: text batches, word spans, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on. A longer text is a step of its own, so no text is ever cut.
CHUNK_BYTES = 1 << 20

#: The bytes that separate words, space and 0x09 to 0x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True


class Chunk:
    """Some rows of a batch: their texts as one byte buffer with row offsets (a null text is empty)."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray):
        self.batch, self.data, self.offsets, self.valid = batch, data, offsets, valid
        self.rows = len(offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into runs of whole rows with about `limit` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            own = offsets[at : end + 1]
            yield Chunk(batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0], valid[at:end])
            at = end


#: Bytes that separate terms: all of ASCII but digits and letters.
NO_TERM = np.arange(256) < 0x80
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: What A-Z become, and all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(chunk: Chunk, separator: np.ndarray = IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    n = len(chunk.data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~separator[chunk.data]
    edge = np.diff(inside)
    begins, ends = edge[:-1] == 1, edge[1:] == -1
    inner = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    if len(inner):  # a word never runs on into the next row
        begins[inner] = inside[1:-1][inner] == 1
        ends[inner - 1] = inside[1:-1][inner - 1] == 1
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, chunk.offsets)


_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo 2**64, and their inverses (the base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        have = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 21:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray, shift: int = 33) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(shift))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of values[start:end] for every span."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 250_000) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, in steps of about `limit` bytes to keep memory small."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, "right")))
        low, high = starts[at], ends[end - 1]
        out[at:end] = rolling(_BYTE_VALUES[data[low:high]], starts[at:end] - low, ends[at:end] - low, _BASES[0])
        at = end
    return mix(out + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, firsts: np.ndarray, width: int, base: int = _BASES[1]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words within one row, and the index of the word that each starts at."""
    room = np.zeros(len(words) + 1, np.int32)
    counts = np.diff(firsts)
    has = counts >= width
    np.add.at(room, firsts[:-1][has], 1)
    np.add.at(room, firsts[1:][has] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(room[:-1]))
    return mix(rolling(words, at, at + width, base), 31), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space within each row: bytes, row offsets, word starts and word ends there."""
    lengths = ends - starts
    last = np.zeros(len(starts) + 1, bool)
    last[firsts[1:] - 1] = True
    gaps = np.where(last[: len(starts)], 0, 1)
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + gaps, out=to[1:])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    out[ragged(to[:-1], lengths)] = data[ragged(starts, lengths)]
    return out, to[firsts], to[:-1], to[:-1] + lengths


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Differences of whole numbers, zigzag-coded, lowest bytes first: small steps leave zeros that compress away."""
    d = np.diff(values.astype(np.int64), prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).astype("<u8")
    return z.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int = 8) -> np.ndarray:
    """What planes() was given."""
    n = len(data) // width
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    z = full.reshape(-1).view("<u8")
    return np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -((z & np.uint64(1)).astype(np.int64)))
