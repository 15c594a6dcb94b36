"""Importance resampling: documents drawn by how much likelier a target's word runs are than the corpus' own.

Features are all runs of 1 to 3 words of a text, hashed into `BUCKETS` buckets by CRC-32. A text's words get their CRC once, and those of runs follow from
them by CRC's own arithmetic. Two passes read the texts: one counts buckets, task by task; the next scores every text by an array of gains, one a bucket.

Gumbel noise that hangs on a document's id and the seed is added to its weight, so the greatest scores are a draw in proportion to exp(weight / 1000).
Scores are whole numbers. Their histogram is exact: ranges of scores, bounded in number, are summed up from the greatest on the driver, and within
a range a window sums its scores; so each score knows how many documents lie above it, and the cutoff is found before any document is sorted. Only documents
at or above the cutoff are shuffled, to get their place among those of one score.

Defined cases: a null or empty text has no features, weight 0, and too few words to be drawn. A row with a null doc_id counts as a text of the corpus, has a null score
and is never drawn, nor does it count among those that are drawn from. Repeated rows are rows of their own; those alike in doc_id and score take
consecutive ranks. An empty target gives the gains of counts of zero. Extra columns stay in resample() and are ignored in digests().
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm._spark import stable
from tidelens.llm._text import LOWER, NO_TERM, Chunk, chunks, word_spans

BUCKETS, LONGEST_RUN = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Ranges of scores whose counts the driver sums up.
RANGES = 4096

#: Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
#: Bytes up to which a CRC is carried on by one table; more are carried on by powers of two.
_FEW = 64


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _compose(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each byte, applied to crc."""
    out = table[0][crc & 255]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


@lru_cache(maxsize=1)
def _zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """What n zero bytes do to a CRC: for n up to _FEW, and for n = 1, 2, 4, 8 and so on."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    step = _byte_table()
    few = [unit]
    for _ in range(_FEW):
        few.append(step[few[-1] & 255] ^ (few[-1] >> np.uint32(8)))
    powers = [few[1]]
    for _ in range(31):
        powers.append(_compose(powers[-1], powers[-1]))
    return np.stack(few), powers


def carry_on(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC's part in that of a longer string: `lengths` more bytes follow, whose own CRC is to be added by xor."""
    few, powers = _zeros()
    own = np.minimum(lengths, _FEW)
    out = few[own, 0, crc & 255]
    for k in range(1, 4):
        out ^= few[own, k, (crc >> np.uint32(8 * k)) & 255]
    if (long := np.flatnonzero(lengths > _FEW)).size:
        left, some = lengths[long], crc[long]
        for i in range(int(left.max()).bit_length()):
            has = (left >> i & 1).astype(bool)
            some[has] = _compose(powers[i], some[has])
        out[long] = some
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    table, crc = _byte_table(), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    todo = np.flatnonzero(lengths <= _FEW)
    for j in range(_FEW):
        todo = todo[lengths[todo] > j]
        if not len(todo):
            break
        crc[todo] = table[(crc[todo] ^ data[starts[todo] + j]) & 255] ^ (crc[todo] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _FEW):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return crc


def feature_buckets(chunk: Chunk, runs: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of every row; and for each length of run the buckets of all runs, row by row, with the row's offsets in them."""
    data = LOWER[chunk.data]
    starts, ends, firsts = word_spans(chunk, NO_TERM)
    lengths = ends - starts
    crc = word_crcs(data, starts, lengths)
    space = np.full(len(starts), zlib.crc32(b" "), np.uint32)
    after = carry_on(space, lengths) ^ crc
    counts, found, whole = np.diff(firsts), [], crc
    last = np.repeat(firsts[1:], counts)
    for n in range(1, runs + 1):
        if n > 1:
            whole = carry_on(whole[:-1], lengths[n - 1 :] + 1) ^ after[n - 1 :]
        inside = np.arange(len(whole)) + n <= last[: len(whole)]
        found.append(((whole[inside] % np.uint32(buckets)).astype(np.int64), np.append(0, np.cumsum(np.maximum(counts - n + 1, 0)))))
        if not len(whole):
            break
    return counts, found


def _count(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for chunk in chunks(batches, text):
            for buckets, _ in feature_buckets(chunk)[1]:
                counts += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": counts[some]})

    return run


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds."""
    found = texts.select(F.col(text).alias("text")).mapInArrow(_count("text"), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.collect():  # BUCKETS rows at most
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, rounded down."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    more = float(s_all + len(corpus)), float(t_all + len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * more[0] / ((s + 1) * more[1]))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(at: str, gain: np.ndarray, whole_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, at):
            words, found = feature_buckets(chunk)
            n, weight = np.zeros(chunk.rows, np.int64), np.zeros(chunk.rows, np.int64)
            for buckets, offsets in found:
                n += np.diff(offsets)
                weight += np.diff(np.append(0, np.cumsum(gain[buckets]))[offsets])
            own = {c: chunk.column(c) for c in chunk.batch.schema.names if whole_too or c != at}
            yield pa.RecordBatch.from_pydict(own | {"n_words": pa.array(words, pa.int64()), "n_features": n, "weight": weight})

    return run


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, whole_too: bool = True) -> tuple[DataFrame, str]:
    """The columns of docs as c0, c1 and so on (the text if whole_too), n_words, n_features, weight and score; and the name of the doc_id among them."""
    names = docs.columns
    id_, at = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*[f for f in plain.schema.fields if whole_too or f.name != at], *T._parse_datatype_string("n_words long, n_features long, weight long").fields])
    found = plain.mapInArrow(_weigh(at, gain, whole_too), schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return found.withColumn("score", (F.col("weight") + noise).cast("long")), id_


def draw(rows: DataFrame, id_: str, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows, which are kept where each use reads the same, with rank: the place of those drawn by score, null for all others."""
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = stable(rows.filter(may).groupBy("score").agg(F.count("*").alias("n")))
    low, high, total = counts.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    wanted = percent * (total or 0) // 100
    nobody = F.lit(None).cast("long")
    if not wanted:
        return rows.withColumn("rank", nobody)
    width = (high - low) // RANGES + 1
    of = F.floor((F.col("score") - low) / width).cast("int")  # a range; double precision is exact here up to 2**53
    above, before = {}, 0
    for part, n in counts.groupBy(of.alias("part")).agg(F.sum("n")).orderBy(F.desc("part")).collect():  # RANGES rows at most
        above[part], before = before, before + n
        if before >= wanted:
            break
    offsets = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("part", of).filter(F.col("part") >= min(above)).withColumn("before", offsets[F.col("part")] + F.coalesce(F.sum("n").over(w), F.lit(0)))
    places = stable(places.filter(F.col("before") < wanted).select("score", "before"))
    cutoff = places.agg(F.min("score")).first()[0]
    among = F.row_number().over(Window.partitionBy("score").orderBy(id_, "n_features", "weight"))
    chosen = rows.filter(may & (F.col("score") >= cutoff)).join(places, "score").withColumn("rank", (F.col("before") + among).cast("long"))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*rows.columns, "rank")
    return chosen.unionByName(rows.filter(~may | (F.col("score") < cutoff) | F.col("score").isNull()).withColumn("rank", nobody))


def digests(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; target: text."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows, id_ = scored(docs.select("doc_id", "text"), gain, seed, False)
    return draw(stable(rows), id_, percent).select(F.col(id_).alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs with all their columns, and weight, score and rank, which take the place of columns with their names."""
    docs = docs.drop("weight", "score", "rank")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows, id_ = scored(docs, gain, seed)
    drawn = draw(stable(rows), id_, percent).filter("rank is not null")
    return drawn.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "weight", "score", "rank")
