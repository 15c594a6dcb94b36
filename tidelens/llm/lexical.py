"""Ranked lexical search: a bit-sliced index of impacts, summed by bitwise arithmetic.

An item's score for a document is the sum, over the item's terms, of the term's weight times a saturating share of its count in the document; all whole numbers.

One pass over the texts keeps the counts of those terms that items hold, packed chunk by chunk, and each document's length; the corpus'
statistics come from these. Chunks are then dealt to blocks of some BLOCK documents. In a block the impacts of a term are bitmaps over its documents, one for each
binary digit: slices. For an item the slices of its terms are added like binary numbers, all documents of the block at once (exclusive or for the digits, and and or
for carries; a term that the item repeats is added shifted, once for each binary digit of its number). The top k come from the sums' slices, the most significant
first: documents with the digit stay if they are enough, else they are taken and the search goes on among those without it. Documents that all slices leave
together have equal scores, and go in by doc_id. The best k of each block are ranked by a window.

Items are taken in blocks of about PAIRS pairs of an item and a term, so what the driver and the tasks hold of them is bounded, and every document is
scored for every item.

Defined cases: a null text and one without a term have no part in the statistics. A row with a null doc_id counts in the statistics and is never returned. Repeated rows of documents are
documents of their own; equal ones may both be returned, under ranks of their own. Rows that share an item_id are one item with the terms of all of them; an item without a term, or
whose terms no document holds, has no row. Extra columns are ignored. A very long text is held in memory whole.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm._spark import forget, parts, stable
from tidelens.llm._text import LOWER, NO_TERM, chunks, planes, span_hashes, unplanes, word_spans

TOP = 10
#: A term counted tf times in a document of mean length weighs PARTS * tf / (1000 * tf + STEEP * 100); SLOPE hundredths of the length count.
PARTS, STEEP, SLOPE = 1_000_000_000, 8, 75
#: Documents that are summed up together.
BLOCK = 16_384
#: Pairs of an item and a term in one pass over the texts.
PAIRS = 100_000
#: Terms whose slices a task keeps: some 70 KB each.
KEPT = 512

_POSTINGS = "chunk long, rows long, documents long, terms long, postings long, docs binary, lengths binary, row binary, term binary, tf binary"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term and times."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _hashes(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(x) for x in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)


def _post(terms: list[str]):
    """Each chunk's documents and how often they hold the terms, in one row."""
    codes = _hashes(terms)
    order = np.argsort(codes)
    codes = codes[order]
    sizes = np.array([len(t.encode()) for t in terms])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = pa.Codec("zstd", 1), TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            chunk.data = LOWER[chunk.data]
            starts, ends, firsts = word_spans(chunk, NO_TERM)
            own = span_hashes(chunk.data, starts, ends)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            known = np.flatnonzero((codes[at] == own) & (sizes[at] == ends - starts))
            lengths = np.diff(firsts)
            row = np.repeat(np.arange(chunk.rows), lengths)[known]
            pairs, tf = np.unique(row * len(codes) + order[at[known]], return_counts=True)
            ids = chunk.column("doc_id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            # Rows without a doc_id, and those without a term, only count in the statistics.
            docs, may = ids.fill_null(0).to_numpy(), valid & (lengths > 0)
            place = np.cumsum(may) - 1
            # The number of documents that hold a term needs all rows: those that can't be returned come last, under no document.
            row = np.where(may, place, chunk.rows)[pairs // len(codes)]
            packed = {"docs": planes(docs[may]), "lengths": planes(lengths[may], 5), "row": planes(row, 5), "term": planes(pairs % len(codes), 5), "tf": planes(tf, 5)}
            counts = {"chunk": (task << 32) + number, "rows": int(may.sum()), "documents": int((lengths > 0).sum()), "terms": int(lengths.sum()), "postings": len(pairs)}
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in counts.items()} | {k: pa.array([codec.compress(v, asbytes=True)], pa.binary()) for k, v in packed.items()})

    return run


def _unpack(table: pa.RecordBatch | pa.Table, name: str, count: str, width: int = 5) -> list[np.ndarray]:
    codec = pa.Codec("zstd", 1)
    return [unplanes(codec.decompress(x, width * n, asbytes=True), width) for x, n in zip(table.column(name).to_pylist(), table.column(count).to_pylist())]


def _document_counts(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            for own in _unpack(batch, "term", "postings"):
                counts += np.bincount(own, minlength=terms)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": some, "n": counts[some]})

    return run


def slices(places: np.ndarray, impacts: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps of the binary digits of impacts, the least significant first, over `size` documents (a multiple of 64)."""
    height = int(impacts.max()).bit_length() if len(impacts) else 0
    digits = np.unpackbits(impacts.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :height]
    dense = np.zeros((height, size), np.uint8)
    dense[:, places] = digits.T
    return np.packbits(dense, axis=1, bitorder="little").view(np.uint64).reshape(height, size // 64)


def add(total: list[np.ndarray], more: np.ndarray, shift: int = 0) -> None:
    """total += more << shift, document by document, where both are lists of slices."""
    carry = None
    for i in range(shift, shift + len(more)) if len(more) else ():
        x = more[i - shift]
        while len(total) <= i:
            total.append(np.zeros_like(x))
        a = total[i]
        either = a ^ x
        both = a & x
        if carry is None:
            total[i], carry = either, both
        else:
            total[i] = either ^ carry
            carry = both | (either & carry)
    i = shift + len(more)
    while carry is not None and carry.any():
        if len(total) <= i:
            total.append(carry)
            break
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def _set(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def top_places(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k greatest positive sums; of equal ones the first places."""
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = reduce(np.bitwise_or, total)
    taken, have = np.zeros_like(open_), 0
    if _set(open_) > k:
        for x in reversed(total):
            with_ = open_ & x
            n = _set(with_)
            if have + n > k:
                open_ = with_
            else:
                taken, have, open_ = taken | with_, have + n, open_ & ~x
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    found = np.concatenate([places(taken), places(open_)[: k - have]])
    values = np.zeros(len(found), np.int64)
    for i, x in enumerate(total):
        values |= ((x[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
    return found, values


def _search(asked: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, terms: int, k: int):
    """The best k documents of a block for every item. asked: the (term, times) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"rows": pa.array([], pa.int64())})])
        if not table.num_rows or not sum(table.column("rows").to_pylist()):
            return
        counts = np.array(table.column("rows").to_pylist())
        docs, lengths = np.concatenate(_unpack(table, "docs", "rows", 8)), np.concatenate(_unpack(table, "lengths", "rows"))
        rows, term, tf = (_unpack(table, c, "postings") for c in ("row", "term", "tf"))
        base = np.cumsum(counts) - counts
        keep = [np.flatnonzero(r < n) for r, n in zip(rows, counts)]
        row = np.concatenate([b + r[own] for b, r, own in zip(base, rows, keep)])
        term, tf = (np.concatenate([x[own] for x, own in zip(of, keep)]) for of in (term, tf))
        del table, rows
        order = np.argsort(docs, kind="stable")  # places follow doc_ids
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        docs, size = docs[order], -(-len(docs) // 64) * 64
        m = 100 - SLOPE + (SLOPE * lengths * documents) // terms
        impact = weights[term] * ((PARTS * tf) // (1000 * tf + STEEP * m[row]))
        by = np.argsort(term, kind="stable")
        term, place, impact = term[by], place[row[by]], impact[by]
        cuts = np.searchsorted(term, np.arange(len(weights) + 1))
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(t: int) -> np.ndarray:
            if t in kept:
                kept.move_to_end(t)
            else:
                own = slice(cuts[t], cuts[t + 1])
                kept[t] = slices(place[own], impact[own], size)
                if len(kept) > KEPT:
                    kept.popitem(last=False)
            return kept[t]

        out = {"item": [], "doc_id": [], "score": []}
        for item, pairs in enumerate(asked):
            total: list[np.ndarray] = []
            for t, times in pairs:
                if cuts[t] < cuts[t + 1]:
                    for shift in range(times.bit_length()):
                        if times >> shift & 1:
                            add(total, of(t), shift)
            found, values = top_places(total, k)
            out["item"].append(np.full(len(found), item))
            out["doc_id"].append(docs[found])
            out["score"].append(values)
        yield pa.RecordBatch.from_pydict({c: np.concatenate(x).astype(np.int64) for c, x in out.items()})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    asked = stable(asked_terms(items))
    turns = parts(asked.count(), pairs)
    found = []
    for turn in range(turns):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id", "term").collect()  # about `pairs` rows
        if own:
            found.append(_search_some(spark, docs.select("doc_id", "text"), own, k, block))
    forget(asked)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_some(spark, docs: DataFrame, own: list, k: int, block: int) -> DataFrame:
    """item_id, doc_id and score of the best k documents of each block, for one block of items."""
    terms = sorted({r.term for r in own})
    number = {t: i for i, t in enumerate(terms)}
    of: dict[int | None, list[tuple[int, int]]] = {}
    for r in own:
        of.setdefault(r.item_id, []).append((number[r.term], r.times))
    posted = stable(docs.mapInArrow(_post(terms), _POSTINGS))
    rows, documents, all_terms = (int(x or 0) for x in posted.agg(F.sum("rows"), F.sum("documents"), F.sum("terms")).first())
    weights = np.zeros(len(terms), np.int64)
    for t, n in posted.mapInArrow(_document_counts(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row a term
        weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    blocks = parts(rows, block)
    dealt = posted.repartitionById(blocks, F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int"))
    best = dealt.mapInArrow(_search(list(of.values()), weights, documents, all_terms, k), "item long, doc_id long, score long")
    ids = spark.createDataFrame(list(enumerate(of)), "item long, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
