"""Bootstrap of a long-short spread, where what is shuffled doesn't grow with the number of resamples.

A resample's n draws with replacement are counts of rows, which are multinomial. Rows lie in blocks by a hash of their key, and a block's share of the draws comes from halving:
of the draws that fall on a range of blocks, those on its left half are binomial. The draws of every half come from a generator that the seed and the
range name, so each task finds its own block's share alone, in as many steps as the tree of blocks is deep, and all tasks agree. Within its block a task
draws rows and passes on five sums a resample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a block should have, and blocks there are at most: their sizes are known to every task.
ROWS, BLOCKS = 50_000, 20_000

_SUMS = "resample int, n_long long, long double, n_short long, short double"


def shares(sizes: np.ndarray, block: int, times: int, seed: int) -> np.ndarray:
    """How many of all draws fall on one block, for each resample."""
    before = np.append(0, np.cumsum(sizes))
    low, high, draws = 0, len(sizes), np.full(times, before[-1])
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(draws, (before[middle] - before[low]) / max(1, before[high] - before[low]))
        if block < middle:
            high, draws = middle, left
        else:
            low, draws = middle, draws - left
    return draws


def block_sums(side: np.ndarray, ret: np.ndarray, draws: np.ndarray, block: int, seed: int) -> dict[str, np.ndarray]:
    """The sums of each resample's draws from one block's rows: numbers and returns of those whose side is 1, and -1."""
    rng, held = np.random.default_rng([seed, block]), np.stack([side == 1, np.where(side == 1, ret, 0.0), side == -1, np.where(side == -1, ret, 0.0)])
    sums = np.stack([held[:, rng.integers(0, len(ret), n)].sum(1) for n in draws]) if len(draws) else np.zeros((0, 4))
    return {"n_long": sums[:, 0].astype(np.int64), "long": sums[:, 1], "n_short": sums[:, 2].astype(np.int64), "short": sums[:, 3]}


def _draw(sizes: np.ndarray, times: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # In an order that doesn't hang on how rows have come here.
        table = table.sort_by([(c, "ascending") for c in ("block", "key", "side", "ret")])
        blocks, side, ret = (table.column(c).to_numpy() for c in ("block", "side", "ret"))
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
            block = int(blocks[a])
            sums = block_sums(side[a:b], ret[a:b], shares(sizes, block, times, seed), block, seed)
            yield pa.RecordBatch.from_pydict({"resample": pa.array(np.arange(times), pa.int32())} | sums)

    return run


def spreads(df: DataFrame, side: str, ret: str, key: str, times: int, seed: int = 13, rows: int = ROWS) -> DataFrame:
    """resample and spread: the mean return of the draws whose side is 1, less that of those whose side is -1. Rows without a return take no part."""
    own = df.filter(F.col(ret).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(side).cast("int").alias("side"), F.col(ret).cast("double").alias("ret"))
    blocks = max(1, min(BLOCKS, -(-own.count() // rows)))
    placed = own.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, np.int64)
    for block, n in placed.groupBy("block").count().collect():  # BLOCKS rows at most
        sizes[block] = n
    sums = placed.repartitionById(blocks, F.col("block")).mapInArrow(_draw(sizes, times, seed), _SUMS)
    total = sums.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("n_long", "long", "n_short", "short")])
    return total.select("resample", (F.try_divide("long", "n_long") - F.try_divide("short", "n_short")).alias("spread"))


def interval(found: DataFrame) -> DataFrame:
    """mean, deviation, positive (share of spreads above 0), and low and high: the 2.5 and 97.5 % spreads by index. One row a resample comes in."""
    at = lambda p: F.try_element_at(F.sort_array(F.collect_list("spread")), F.floor(F.count("spread") * F.lit(p)).cast("int") + 1)
    up = F.avg(F.when(F.col("spread") > 0, 1.0).otherwise(0.0))
    return found.filter("spread is not null").agg(F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("deviation"), up.alias("positive"), at(0.025).alias("low"), at(0.975).alias("high"))
