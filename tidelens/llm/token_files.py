"""Token-ID output: texts as bit-packed token ids in block files, and reading them back.

The files are a Parquet table (so Spark's committer makes them whole or absent, on any store) with one row for each
block of about CHUNK_BYTES of text, in ascending doc_id order:

    part int, block int      place: blocks of a part in order, parts in order
    base long                ids in the same part before this block
    bits int                 bits of an id: the fewest that hold the vocabulary
    doc_ids array<long>      documents of the block
    ends array<long>         where each document's ids end, counted in ids from the block's start
    payload binary           the ids, `bits` bits each, lowest bit first, without gaps

Any run of ids can be unpacked by itself, because id k stands at bit k * bits.

Defined cases: a null or empty text has only the end id. Rows with a null doc_id come first. Rows that repeat a doc_id stay
rows of their own, in the order of hashes of their texts, and may lie in several tasks. A text longer than a block is a block of its own; it is held in
memory whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm._spark import tasks
from tidelens.llm._text import chunks, ragged
from tidelens.llm._tokens import library_encoder, vocabulary_size

_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
_BLOCK_SQL = "part int, block int, base long, bits int, n_ids long, doc_ids array<long>, ends array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, step: int = 1 << 17) -> bytes:
    """Ids as `bits`-bit numbers, lowest bit first. Steps are multiples of 8 ids, so they end on whole bytes."""
    if bits in (8, 16):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    out = [np.packbits(((ids[at : at + step].astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little") for at in range(0, len(ids), step)]
    return b"".join(x.tobytes() for x in out)


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first .. first+count-1 of a payload with ids of at most 25 bits."""
    if bits in (8, 16):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low, high = first * bits >> 3, (first + count) * bits + 7 >> 3
    raw = np.zeros(high - low + 4, np.uint8)
    raw[:-4] = np.frombuffer(payload, np.uint8, high - low, low)
    at = np.arange(first, first + count, dtype=np.int64) * bits - low * 8
    byte, out = at >> 3, np.zeros(count, np.uint32)
    for k in range(4):
        out |= raw[byte + k].astype(np.uint32) << np.uint32(8 * k)
    return (out >> (at & 7).astype(np.uint32)) & np.uint32((1 << bits) - 1)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with end_id after each, and their offsets."""
    to = offsets + np.arange(len(offsets))
    out = np.full(int(to[-1]), end_id, np.int32)
    out[ragged(to[:-1], np.diff(offsets))] = ids
    return out, to


def _blocks(tokenizer: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, encoder = TaskContext.get().partitionId(), 0, library_encoder(tokenizer)
        for block, chunk in enumerate(chunks(batches)):
            ids, ends = with_end(*encoder.ids(chunk), end_id)
            yield pa.RecordBatch.from_pydict({"part": [part], "block": [block], "base": [base], "bits": [bits], "n_ids": [len(ids)], "doc_ids": [chunk.column("doc_id").to_pylist()], "ends": [ends[1:]], "payload": [pack(ids, bits)]}, schema=_BLOCK)
            base += len(ids)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, append end_id, and write the ids in ascending doc_id order."""
    bits = bits_for(max(vocabulary_size(tokenizer), end_id + 1))
    place = ["doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")]  # alike rows spread by the last
    ordered = docs.select("text", *place).repartitionByRange(tasks(docs), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    ordered.select("doc_id", "text").mapInArrow(_blocks(tokenizer, bits, end_id), _BLOCK_SQL).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with `start`: how many ids all blocks before hold."""
    blocks = spark.read.schema(_BLOCK_SQL).parquet(path)
    # One row for each written part: as many as the writing stage had tasks.
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    known = spark.createDataFrame(starts, "part int, part_start long")
    return blocks.join(F.broadcast(known), "part").withColumn("start", F.col("part_start") + F.col("base")).drop("part_start")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.array(row["ends"], np.int64)
            begins = np.append(0, ends[:-1])
            raw = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + row["start"]), "n_tokens": pa.array(ends - begins), "ids_crc32": pa.array(crc, pa.int64())})


def digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of every document in read_token_files()."""
    return blocks.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            flat = pa.array(unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype(np.int32))
            offsets = pa.array([0, *row["ends"]], pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.ListArray.from_arrays(offsets, flat)})


def token_ids(blocks: DataFrame) -> DataFrame:
    """doc_id and ids of every document in read_token_files()."""
    return blocks.mapInArrow(_ids, "doc_id long, ids array<int>")
