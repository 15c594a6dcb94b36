"""Research statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.windows import corr, ratio
from tidelens.operators.panel import numbered, spearman


def rank_ic(df: DataFrame, x: str, y: str, date: str = "date", least: int = 5, extra: list[str] | None = None, least_deviation: float | None = None) -> DataFrame:
    """date, ic and n: the correlation of tie-average ranks of the pairs that are both known, for dates with at least `least` of them.

    least_deviation: dates on which x or y varies less than this drop out. extra: columns that are constant on a date, kept.
    """
    a, b = spearman(x, y, date)
    keep = extra or []
    pairs = df.select(date, *keep, F.col(x).alias("_x"), F.col(y).alias("_y"), a.alias("_a"), b.alias("_b")).filter("_a is not null and _b is not null")
    out = pairs.groupBy(date, *keep).agg(corr("_a", "_b").alias("ic"), F.count("*").alias("n"), F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy")).filter(F.col("n") >= least)
    if least_deviation is not None:
        out = out.filter((F.col("_sx") > least_deviation) & (F.col("_sy") > least_deviation))
    return out.drop("_sx", "_sy")


def ic_summary(ics: DataFrame, group: list[str] | None = None, ddof: int = 0, ridge: float = 1e-6) -> DataFrame:
    """Mean, deviation, information ratio, share of positive dates and t of the dates' ics."""
    spread = F.stddev_pop("ic") if ddof == 0 else F.stddev_samp("ic")
    out = ics.groupBy(*(group or [])).agg(F.avg("ic").alias("mean"), spread.alias("deviation"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive"), F.count("ic").alias("n"))
    return out.withColumns({"ir": F.col("mean") / (F.col("deviation") + ridge), "t": ratio("mean", F.col("deviation") / F.sqrt("n"))})


def newey_west(df: DataFrame, x: str, group: list[str], date: str = "date", lags: int = 4, least: int = 5) -> DataFrame:
    """n, mean and t of the mean with Bartlett-weighted autocovariances up to min(n - 1, lags); t is NULL for fewer than `least` values."""
    w = Window.partitionBy(*group)
    rows = df.filter(F.col(x).isNotNull())
    rows = rows.withColumn("_e", F.col(x) - F.avg(x).over(w)).withColumn("_n", F.count(x).over(w))
    line = w.orderBy(date)
    rows = rows.select("*", *[(F.col("_e") * F.lag("_e", k).over(line)).alias(f"_c{k}") for k in range(1, lags + 1)])
    top = F.least(F.col("_n") - 1, F.lit(lags))
    long = F.pow("_e", F.lit(2.0))
    for k in range(1, lags + 1):
        long = long + F.when(F.lit(k) <= top, 2 * (1 - k / (top + 1)) * F.coalesce(f"_c{k}", F.lit(0.0))).otherwise(0.0)
    out = rows.withColumn("_v", long).groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.sum("_v").alias("_v"))
    return out.withColumn("t", F.when((F.col("n") >= least) & (F.col("_v") > 0), F.col("mean") / F.sqrt(F.col("_v") / (F.col("n") * F.col("n"))))).drop("_v")


def ndcg(df: DataFrame, score: str, gain: str, group: str, k: int = 10) -> DataFrame:
    """Linear-gain NDCG at k of each group. Equal scores share the mean of the discounts of their places."""
    w = Window.partitionBy(group)
    discount = F.when(F.col("_p") <= k, 1 / F.log2(F.col("_p") + 1)).otherwise(0.0)
    best = F.when(F.col("_q") <= k, 1 / F.log2(F.col("_q") + 1)).otherwise(0.0)
    rows = df.filter(F.col(score).isNotNull() & F.col(gain).isNotNull())
    rows = rows.withColumn("_p", F.row_number().over(w.orderBy(F.desc(score)))).withColumn("_q", F.row_number().over(w.orderBy(F.desc(gain))))
    rows = rows.withColumn("_d", F.avg(discount).over(Window.partitionBy(group, score)))
    out = rows.groupBy(group).agg(F.sum(F.col(gain) * F.col("_d")).alias("_a"), F.sum(F.col(gain) * best).alias("_b"))
    return out.select(group, F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).otherwise(0.0).alias("ndcg"))


def bootstrap_spread(df: DataFrame, side: str, ret: str, entity: str, times: int = 500, seed: int = 13) -> DataFrame:
    """mean, deviation, low and high (2.5 and 97.5 % by index) of the long-short spread over resamples of n draws with replacement.

    The k-th draw of resample b is row xxhash64(k, b, seed) modulo n, in the order of `entity`, so a rerun draws alike. Draws are counted by resample and row
    before they meet the rows: a resample is never gathered.
    """
    rows = numbered(df.select(entity, side, ret), [entity, side, ret], "_row")
    n = rows.count()
    draws = rows.select("_row", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_b"))
    draws = draws.select("_b", F.pmod(F.xxhash64("_row", F.col("_b").cast("long"), F.lit(seed).cast("long")), F.lit(max(n, 1)).cast("long")).alias("_row"))
    drawn = draws.groupBy("_b", "_row").agg(F.count("*").alias("_w")).join(rows, "_row")
    weigh = lambda s: F.sum(F.when(F.col(side) == s, F.col("_w") * F.col(ret))) / F.sum(F.when(F.col(side) == s, F.col("_w")))
    spreads = drawn.groupBy("_b").agg((weigh(1) - weigh(-1)).alias("s"))
    at = lambda p: F.element_at(F.sort_array(F.collect_list("s")), F.floor(F.count("s") * F.lit(p)).cast("int") + 1)  # noqa: E731  as many rows as resamples
    return spreads.agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("deviation"), at(0.025).alias("low"), at(0.975).alias("high"))
