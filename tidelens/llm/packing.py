"""Best-fit packing: texts as token sequences of at most `capacity` ids, in as few sequences as it can.

Hierarchical residual packing. Whole capacities are sequences at once. The other pieces are dealt to tasks, each of which
packs best-fit with the longest first, and gives off its nearly full sequences. The underfull ones go up a tree as
items of the next round, dealt to fewer tasks, until one bounded task has the rest or a round no longer gains. A round that would save less than `GAIN` of
its items ends the packing: its underfull sequences stay as they are, and no document is lost. On a corpus that packs well that costs at most that share of the last round's sequences.

Only a text longer than `capacity` is cut: its first piece is the remainder, all others are whole capacities.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed as documents of their own, and spread over tasks by their place in the
table. A very long text is encoded whole and gives many pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._spark import MANY_TASKS, parts, stable
from tidelens.llm._text import chunks, ragged
from tidelens.llm._tokens import library_encoder
from tidelens.llm.token_files import with_end

CAPACITY = 1024
#: Items that one task packs, up to MANY_TASKS tasks; beyond that tasks grow.
ITEMS = 10_000
#: Free places up to which a sequence counts as nearly full.
SLACK = 8
#: A round must save at least this share of the items it gets, or packing ends.
GAIN = 0.02

_ITEM = "fill int, salt long, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for chunk in chunks(batches):
            ids, offsets = with_end(*encoder.ids(chunk), end_id)
            sizes = np.diff(offsets)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(chunk.rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = sizes - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            raw = ids.astype("<u4").tobytes()
            at = offsets[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(fills: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each sequence: longest first, each into the sequence with the least room that holds it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there is a sequence with r places left
    bins: list[list[int]] = []
    for i in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        need = fills[i]
        fitting = some >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            bins[own].append(i)
            left -= need
        else:
            own, left = len(bins), capacity - need
            bins.append([i])
        room[left].append(own)
        some |= 1 << left
    return bins


def _pack(capacity: int):
    """One task's items as sequences: their members one after another, with each member's place in the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"fill": pa.array([], pa.int32())})])
        if not table.num_rows:
            return
        table = table.sort_by([("fill", "ascending"), ("salt", "ascending")]).combine_chunks()
        fills, salts = (table.column(c).to_numpy() for c in ("fill", "salt"))
        members = table.column("members").combine_chunks()
        cuts = members.offsets.to_numpy().astype(np.int64) - members.offsets[0].as_py()
        flat = members.flatten()
        found = best_fit(fills.tolist(), capacity)
        for at in range(0, len(found), 4096):
            own = found[at : at + 4096]
            items = np.concatenate([np.array(x, np.int64) for x in own])
            ends = np.cumsum([len(x) for x in own])
            begins = ends - [len(x) for x in own]
            before = np.cumsum(fills[items]) - fills[items]
            before -= np.repeat(before[begins], ends - begins)  # where each item begins in its sequence
            sizes = cuts[items + 1] - cuts[items]
            some = flat.take(pa.array(ragged(cuts[items], sizes)))
            columns = [some.field(i) for i in range(some.type.num_fields)]
            columns[-1] = pa.array(columns[-1].to_numpy() + np.repeat(before, sizes))
            count = np.append(0, np.cumsum(sizes))[np.append(begins, len(items))]
            lists = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays(columns, names=[f.name for f in some.type]))
            yield pa.RecordBatch.from_arrays([pa.array(np.add.reduceat(fills[items], begins), pa.int32()), pa.array(salts[items[begins]]), lists], names=["fill", "salt", "members"])

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, slack: int = SLACK) -> DataFrame:
    """sequence_id and offset of every row of pieces()."""
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    # The salt is a row's own, so that rows alike in all else are dealt to different tasks.
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("salt")
    todo = stable(found.select(F.col("length").cast("int").alias("fill"), salt, F.array(member).alias("members")))
    done = [todo.filter(F.col("fill") >= capacity)]
    todo, turn = todo.filter(F.col("fill") < capacity), 0
    have = todo.count()
    while have:
        n = parts(have, max(items, have / MANY_TASKS))
        deal = F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(n)).cast("int")
        packed = stable(todo.repartitionById(n, deal).mapInArrow(_pack(capacity), _ITEM))
        rest = packed.filter(F.col("fill") < capacity - slack)
        left = rest.count()
        if n == 1 or left > (1 - GAIN) * have:
            done.append(packed)
            break
        done.append(packed.filter(F.col("fill") >= capacity - slack))
        todo, have, turn = rest, left, turn + 1
    full = done[0]
    for more in done[1:]:
        full = full.union(more)
    placed = full.select(F.monotonically_increasing_id().alias("sequence_id"), "members").select("sequence_id", F.explode("members").alias("m"))
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every text."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)
