"""Substring dedup: passages that stand earlier in the corpus are cut out.

Every window of `width` words of every text gets a Rabin-Karp hash. Hashes are dealt to buckets
by a second, independent hash and compared there, 56 bits at a time, so two different windows are taken
for equal with a chance of 2**-(56 + log2(buckets)) a pair. Windows that also start earlier
(smaller doc_id, or the same document and a smaller start) cover words; overlapping and touching
windows merge into maximal intervals, and the words in them go.

A window that many texts share is sent once for each block of texts, and after a few blocks once for each task: a task remembers windows that
it meets again and again, and judges later copies by itself. So a bucket gets a few entries of such a window from each task, not one from each copy.

Defined cases: a null text has no words. Rows with a null doc_id are kept as they are and are no source
for others. Rows that share a doc_id are versions of one document: equal positions in them are not
earlier than one another, and a position that goes in one goes in all. A very long text is a block by itself, held in memory whole
(about 60 bytes a word). Extra columns are ignored, or stay as they are where the result has the columns of docs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm._spark import TASK_BYTES, parts, stable, text_bytes
from tidelens.llm._text import Chunk, _BASES, chunks, mix, planes, ragged, span_hashes, unplanes, window_hashes, word_spans

#: Words in a window.
WIDTH = 20
#: Words of English text take about this many bytes; a window then sends about 9.
_BYTES_A_WORD = 5.5
_HASH_BYTES = 7
_BLOCK_BYTES = 2 << 20
#: Windows that a task remembers of those it has sent: 6.5 MB.
SLOTS = 1 << 18

_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary())])
_SPANS = "doc_id long, first int, stop int"


def _windows(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Hash, bucket hash, doc_id and start of every window, in the order of (doc_id, start) where ids differ."""
    ids = chunk.column("doc_id").to_numpy(zero_copy_only=False)
    starts, ends, firsts = word_spans(chunk)
    words = span_hashes(chunk.data, starts, ends)
    hashes, at = window_hashes(words, firsts, width)
    if not len(at):
        return None
    second, _ = window_hashes(mix(words), firsts, width, _BASES[2])
    row = np.searchsorted(firsts, at, "right") - 1
    docs, start = ids[row].astype(np.int64), at - firsts[row]
    if not (np.diff(docs) >= 0).all() or len(np.unique(ids)) < len(ids):
        order = np.lexsort((start, docs))
        hashes, second, docs, start = hashes[order], second[order], docs[order], start[order]
    return hashes, second, docs, start


def _later(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows, sorted by (doc_id, start), repeat one of an earlier position."""
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    first = first[codes]
    return (docs != docs[first]) | (starts != starts[first])


class Seen:
    """Windows that a task has sent, in a table of a fixed size: one a slot, where a window that was met again since stays."""

    def __init__(self, slots: int = SLOTS):
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.hashes, self.docs, self.starts, self.met = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int8)

    def later(self, hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows were sent before from an earlier position; the others are remembered, as far as there is room."""
        slot = (mix(hashes) >> self.shift).astype(np.int64)
        same = (self.hashes[slot] == hashes) & (self.met[slot] > 0)
        later = same & ((self.docs[slot] < docs) | ((self.docs[slot] == docs) & (self.starts[slot] < starts)))
        held = ~same & (self.met[slot] > 1)
        self.met[slot[held]] = 1
        self.met[slot[same]] = 2
        new = np.flatnonzero(~later & ~held)
        new = new[np.unique(slot[new], return_index=True)[1]]  # one a slot
        at = slot[new]
        fresh = ~same[new]
        self.hashes[at], self.docs[at], self.starts[at] = hashes[new], docs[new], starts[new]
        self.met[at[fresh]] = 1
        return later


def _send(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Seen()
        for number, chunk in enumerate(chunks(batches, limit=_BLOCK_BYTES)):
            if (found := _windows(chunk, width)) is None:
                continue
            hashes, second, docs, starts = found
            block = (task << 24) + number
            later = _later(hashes, docs, starts)
            keep = np.flatnonzero(~later)
            keep = keep[~pd.Series(hashes[keep]).duplicated().to_numpy()]
            again = seen.later(hashes[keep], docs[keep], starts[keep])
            later[keep[again]] = True
            keep = keep[~again]
            rows = {"bucket": [block % buckets], "hashes": [None], "docs": [planes(docs[later])], "starts": [planes(starts[later], 5)]} if later.any() else {"bucket": [], "hashes": [], "docs": [], "starts": []}
            bucket = (second[keep] >> np.uint64(16)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            bucket, keep = bucket[order], keep[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63), append=np.uint64(1 << 63)))
            raw = hashes[keep].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]
            docs, starts = docs[keep], starts[keep]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows["bucket"].append(int(bucket[a]))
                rows["hashes"].append(raw[a:b].tobytes())
                rows["docs"].append(planes(docs[a:b]))
                rows["starts"].append(planes(starts[a:b], 5))
            rows["block"] = [block] * len(rows["bucket"])
            yield pa.RecordBatch.from_pydict(rows, schema=_SENT)

    return run


def _compare(table: pa.Table) -> pa.Table:
    """Of the windows of one bucket, those that repeat an earlier one, by the block that sent them."""
    sent = table.column("hashes").to_pylist()
    blocks, docs, starts = (table.column(c).to_pylist() for c in ("block", "docs", "starts"))
    out = {"block": [b for b, h in zip(blocks, sent) if h is None], "docs": [d for d, h in zip(docs, sent) if h is None], "starts": [s for s, h in zip(starts, sent) if h is None]}
    own = [i for i, h in enumerate(sent) if h is not None]
    if own:
        counts = [len(sent[i]) // _HASH_BYTES for i in own]
        raw = np.zeros((sum(counts), 8), np.uint8)
        raw[:, :_HASH_BYTES] = np.frombuffer(b"".join(sent[i] for i in own), np.uint8).reshape(-1, _HASH_BYTES)
        hashes = raw.reshape(-1).view("<u8")
        twice = np.flatnonzero(pd.Series(hashes).duplicated(keep=False).to_numpy())
        source = np.repeat(np.arange(len(own)), counts)[twice]
        ids = np.concatenate([unplanes(docs[i]) for i in own])[twice]
        at = np.concatenate([unplanes(starts[i], 5) for i in own])[twice]
        hashes = hashes[twice]
        order = np.lexsort((at, ids))
        later = _later(hashes[order], ids[order], at[order])
        order = order[later]
        order = order[np.lexsort((at[order], ids[order], source[order]))]
        source, ids, at = source[order], ids[order], at[order]
        cuts = np.flatnonzero(np.diff(source, prepend=-1, append=-1)) if len(source) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            out["block"].append(blocks[own[source[a]]])
            out["docs"].append(planes(ids[a:b]))
            out["starts"].append(planes(at[a:b], 5))
    return pa.Table.from_pydict(out, schema=_FOUND)


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        docs = np.concatenate([unplanes(x) for x in table.column("docs").to_pylist()])
        starts = np.concatenate([unplanes(x, 5) for x in table.column("starts").to_pylist()])
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + width)
        last = np.append(new[1:], True)
        return pa.table({"doc_id": docs[new], "first": pa.array(starts[new], pa.int32()), "stop": pa.array(starts[last] + width, pa.int32())})

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, first, stop: the maximal word intervals that windows repeat from earlier positions."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    buckets = parts(text_bytes(docs) / _BYTES_A_WORD * 11, TASK_BYTES, 16)
    sent = docs.mapInArrow(_send(width, buckets), "bucket int, block long, hashes binary, docs binary, starts binary")
    found = sent.groupBy("bucket").applyInArrow(_compare, "block long, docs binary, starts binary")
    return found.groupBy("block").applyInArrow(_merge(width), _SPANS).distinct()


def _cut(at: str, with_text: bool, whole_too: bool):
    """What is kept of the texts in column `at`, whose repeated intervals are in column `spans`; all other columns pass, and the text if whole_too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, at):
            starts, ends, firsts = word_spans(chunk)
            edge = np.zeros(len(starts) + 1, np.int32)
            spans = chunk.column("spans")
            lengths = np.array([0 if x is None else len(x) for x in spans.to_pylist()], np.int64)
            if lengths.any():
                flat = spans.flatten()
                row = np.repeat(np.arange(chunk.rows), lengths)
                top = np.diff(firsts)[row]
                np.add.at(edge, firsts[row] + np.minimum(flat.field("first").to_numpy(zero_copy_only=False), top), 1)
                np.add.at(edge, firsts[row] + np.minimum(flat.field("stop").to_numpy(zero_copy_only=False), top), -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(keep, out=kept[1:])
            left = kept[firsts]
            a, b = starts[keep], ends[keep]
            # A kept word and the separator after it, written as a space; the last one of a row is cut off.
            tail = np.minimum(b, len(chunk.data) - 1) if len(b) else b
            data = chunk.data.copy()
            inside = ~np.isin(b, chunk.offsets)
            data[tail[inside]] = 0x20
            lengths = b - a + inside
            data = data[ragged(a, lengths)]
            to = np.zeros(len(a) + 1, np.int64)
            np.cumsum(lengths, out=to[1:])
            to = to[left]
            raw = data.tobytes()
            texts = [raw[x:y].rstrip(b" ") for x, y in zip(to[:-1].tolist(), to[1:].tolist())]
            words, left = np.diff(firsts), np.diff(left)
            out = {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(words - left, pa.int64())}
            if with_text:
                same, valid = words == left, chunk.valid
                whole = chunk.column(at).cast(pa.string()).to_pylist()
                out["kept"] = pa.array([whole[i] if same[i] or not valid[i] else texts[i].decode() for i in range(chunk.rows)], pa.string())
            else:
                out["kept"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_pydict({c: chunk.column(c) for c in chunk.batch.schema.names if c != "spans" and (whole_too or c != at)} | out)

    return run


def _cut_out(docs: DataFrame, width: int, with_text: bool, whole_too: bool = False) -> DataFrame:
    """The columns of docs as c0, c1 and so on (the text if whole_too), and n_words, n_removed and kept (a text, or its digest)."""
    names = docs.columns
    id_, at = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    spans = repeated_spans(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    spans = stable(spans.select(F.col("doc_id").alias("to"), "spans", F.lit(True).alias("known")))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*[f for f in plain.schema.fields if whole_too or f.name != at], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    # Joined with the ids first: mapInArrow's columns stand in the order of its schema.
    # Rows without a doc_id find nothing, and are spread by their texts.
    own = plain.withColumn("to", F.coalesce(id_, F.xxhash64(at))).withColumn("known", F.col(id_).isNotNull())
    found = own.join(spans, ["to", "known"], "left").select(*plain.columns, "spans")
    return found.mapInArrow(_cut(at, with_text, whole_too), schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Cut out the repeated windows of every text.

    with_text: all columns of docs, n_words, n_removed and kept_text (the text itself if nothing goes, else
    the kept words joined by one space); these three take the place of columns of docs that have their names. Otherwise doc_id, n_words, n_removed and kept_sha256.
    """
    if not with_text:
        return _cut_out(docs.select("doc_id", "text"), width, False).select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    docs = docs.drop("n_words", "n_removed", "kept_text")
    found = _cut_out(docs, width, True, True)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "n_words", "n_removed", F.col("kept").alias("kept_text"))


def cut_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated windows cut out of its texts; n_chars, where docs has it, follows a text that has changed. All other columns stay as they are."""
    found, names = _cut_out(docs, width, True), docs.columns
    new = {"text": F.col("kept")}
    if "n_chars" in names:
        at = names.index("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col(f"c{at}")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
