"""Byte-level BPE in tasks: split texts into pieces with numpy, encode every distinct piece once.

The pattern that splits texts before merges never lets a token cross pieces, and a piece encodes alike wherever it
stands. So a text's ids are its pieces' ids in order, and the library only has to see pieces that its worker hasn't met.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from tidelens.llm._text import Chunk, ragged, span_hashes

#: Pieces that a worker remembers in each of two generations, as objects and in flat arrays (about 65 bytes a piece).
REMEMBERED, REMEMBERED_FLAT = 250_000, 500_000

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, asked of the library that the pattern runs in: Python's own tables are of another Unicode version."""
    import tiktoken

    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    table = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        # With single bytes for tokens the ids are the bytes of what the pattern matches.
        matches = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(matches.encode_ordinary(text)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_starts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces of all rows, and for each row the index of its first piece (one more at the end).

    The pieces are the matches of the pattern with contractions, letters, numbers and other signs that take one space before
    them, and white space that leaves its last character to what follows.
    """
    data = chunk.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(chunk.rows + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[points]
    n = len(points)
    rows = np.searchsorted(byte, chunk.offsets)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True

    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= row_start
    start = run.copy()
    is_space = kind == _SPACE
    # The last white space before something else starts a piece of its own, and a plain space takes what follows along.
    follows = run[1:n] & ~row_start[1:n] & is_space[:-1]
    last = np.flatnonzero(follows)
    start[last] = True
    plain = last[points[last] == 0x20]
    start[plain + 1] = False
    # Contractions stand alone where a piece starts with the apostrophe.
    mark = np.flatnonzero((points == 0x27) & start[:n])
    mark = mark[mark + 1 < n]
    mark = mark[~row_start[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        two = np.where(row_start[np.minimum(mark + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        for size, which in ((1, short), (2, pair & ~short)):
            at = mark[which]
            start[at + 1] = False
            start[at + 1 + size] = True
    found = np.flatnonzero(start[:n])
    return byte[found], np.searchsorted(found, rows)


def distinct_pieces(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of every piece, then hash, byte start and byte end of each code's first piece, and the first piece of every row."""
    starts, firsts = piece_starts(chunk)
    ends = np.append(starts[1:], len(chunk.data))
    codes, keys = pd.factorize(span_hashes(chunk.data, starts, ends))
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, keys, starts[first], ends[first], firsts


class Encoder:
    """What encode(list of bytes) makes of the pieces of a chunk, one object a piece; it is asked for new ones only."""

    def __init__(self, encode):
        self.encode, self.young, self.old = encode, {}, {}

    def known(self, pieces: list[bytes]) -> list:
        young, old = self.young, self.old
        if len(young) + len(pieces) > REMEMBERED:
            self.young, self.old = young, old = {}, young
        out = [young.get(p) for p in pieces]
        missing = []
        for i, x in enumerate(out):
            if x is None:
                x = old.get(pieces[i])
                if x is None:
                    missing.append(i)
                else:
                    out[i] = young[pieces[i]] = x
        if missing:
            new = [pieces[i] for i in missing]
            for i, p, x in zip(missing, new, self.encode(new)):
                out[i] = young[p] = x
        return out

    def pieces(self, chunk: Chunk) -> tuple[np.ndarray, list, np.ndarray]:
        """Code of every piece, what is known of each code, and the first piece of every row."""
        codes, _, starts, ends, firsts = distinct_pieces(chunk)
        raw = chunk.data.tobytes()
        return codes, self.known([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), firsts


def _put(into: np.ndarray, at: int, what: np.ndarray) -> np.ndarray:
    """`into` with `what` at a place, grown if need be."""
    if at + len(what) > len(into):
        into = np.concatenate([into[:at], np.empty(max(at, len(what)), into.dtype)])
    into[at : at + len(what)] = what
    return into


class _Flat:
    """Up to `room` pieces with their ids in flat arrays, found by hash (open addressing) and then compared byte by byte."""

    def __init__(self, room: int):
        self.n, self.slots = 0, np.full(1 << (2 * room).bit_length(), -1, np.int32)
        self.keys = np.empty(room, np.uint64)
        self.byte_at, self.id_at = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
        self.bytes, self.ids = np.empty(0, np.uint8), np.empty(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of these pieces, -1 for those that aren't here."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            place = self.slots[slot]
            taken = place >= 0
            left, slot, place = left[taken], slot[taken], place[taken]
            hit = self.keys[place] == keys[left]
            out[left[hit]] = place[hit]
            left, slot = left[~hit], slot[~hit] + 1 & len(self.slots) - 1
        have = np.flatnonzero(out >= 0)
        alike = self.byte_at[out[have] + 1] - self.byte_at[out[have]] == lengths[have]
        out[have[~alike]] = -1
        have = have[alike]
        other = data[ragged(starts[have], lengths[have])] != self.bytes[ragged(self.byte_at[out[have]], lengths[have])]
        if other.any():
            out[np.repeat(have, lengths[have])[other]] = -1
        return out

    def add(self, keys: np.ndarray, data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of new pieces, given their bytes and ids one after another."""
        n, out = self.n, np.arange(self.n, self.n + len(keys))
        self.bytes, self.ids = _put(self.bytes, int(self.byte_at[n]), data), _put(self.ids, int(self.id_at[n]), ids)
        self.keys[out], self.n = keys, n + len(keys)
        self.byte_at[out + 1] = self.byte_at[n] + np.cumsum(lengths)
        self.id_at[out + 1] = self.id_at[n] + np.cumsum(counts)
        left, slot = out, self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            wait = self.slots[slot] != left
            left, slot = left[wait], slot[wait] + 1 & len(self.slots) - 1
        return out


class IdEncoder:
    """Ids of the pieces of a chunk; encode(list of bytes) -> (all ids one after another, how many each) is asked for new ones only."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.young, self.old = encode, _Flat(REMEMBERED_FLAT), _Flat(1)

    def known(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of these distinct pieces in the young generation."""
        if self.young.n + len(keys) > len(self.young.keys):
            self.young, self.old = _Flat(max(REMEMBERED_FLAT, len(keys))), self.young
        lengths = ends - starts
        out = self.young.find(keys, data, starts, lengths)
        new = np.flatnonzero(out < 0)
        was = self.old.find(keys[new], data, starts[new], lengths[new])
        back, was, new = new[was >= 0], was[was >= 0], new[was < 0]
        counts = self.old.id_at[was + 1] - self.old.id_at[was]
        found = [(back, self.old.ids[ragged(self.old.id_at[was], counts)], counts)]
        if len(new):
            raw = data.tobytes()
            found.append((new, *self.encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])))
        for which, ids, counts in found:
            out[which] = self.young.add(keys[which], data[ragged(starts[which], lengths[which])], lengths[which], ids, counts)
        return out

    def ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one row after another, and the rows' offsets in them."""
        codes, keys, starts, ends, firsts = distinct_pieces(chunk)
        at = self.known(keys, chunk.data, starts, ends)
        begins = self.young.id_at[at]
        counts = (self.young.id_at[at + 1] - begins)[codes]
        ids = self.young.ids[ragged(begins[codes], counts)]
        to = np.append(0, np.cumsum(counts))
        return ids, to[firsts]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> IdEncoder:
    """The tokenizers library's encoder for a byte-level BPE file, without special tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for at in range(0, len(pieces), 4096):
            found = tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces[at : at + 4096]], add_special_tokens=False)
            own = [x.ids for x in found]
            ids.append(np.fromiter(chain.from_iterable(own), np.int32))
            counts += map(len, own)
        return np.concatenate(ids), np.array(counts, np.int64)

    return IdEncoder(encode)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
