"""Several sampled price paths of one forecast as one, and the choice of next tokens from a distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.windows import ratio

#: Samples that are always drawn, and with the additional ones. Fixed values.
FIRST, ALL = 3, 5
#: z values at which a decision changes, how near to one the first samples must come for more, and the noise that z is over. Fixed values.
BOUNDARIES, NEAR, NOISE = (0.5, 1.0, 1.5), 0.1, 0.0309


def ensemble(samples: DataFrame, key: list[str], sample: str = "sample", step: str = "step") -> DataFrame:
    """key, n_samples, mean_return, std_return (population), predicted_max, predicted_min and predicted_range of each forecast.

    samples: key, sample (from 1), step, close, high, low. The first FIRST samples make a mean path; if its z comes within NEAR of a
    boundary, all ALL samples count, else the first ones. The range is over the mean path's first close.
    """
    rows = samples.filter(F.col(sample) <= ALL).na.drop(subset=key)
    # One shuffle serves all steps. Nothing is joined: a key's rows meet in its own task, and no table of all keys is broadcast, however small it is taken to be.
    steps = rows.repartition(*key).groupBy(*key, sample, step).agg(
        F.min_by("close", step).alias("_close"), F.sum("close").alias("_sum"), F.count("close").alias("_n"), F.max("high").alias("_high"), F.min("low").alias("_low"),
    )
    one = steps.groupBy(*key, sample).agg(
        F.min_by("_close", step).alias("_a"), F.max_by("_close", step).alias("_b"), F.max_by("_sum", step).alias("_sum"), F.max_by("_n", step).alias("_n"),
        F.max("_high").alias("_high"), F.min("_low").alias("_low"), F.max(step).alias("_last"),
    )
    w = Window.partitionBy(*key)
    early = F.col(sample) <= FIRST
    one = one.withColumns({"_start": F.avg(F.when(early, F.col("_a"))).over(w), "_end": F.max(F.when(early, F.col("_last"))).over(w), "_k": F.count(F.when(early, 1)).over(w)}).filter("_end is not null")
    ends = early & (F.col("_last") == F.col("_end"))
    one = one.withColumn("_stop", ratio(F.sum(F.when(ends, F.col("_sum"))).over(w), F.sum(F.when(ends, F.col("_n"))).over(w)))
    z = F.abs((F.col("_stop") / F.col("_start") - 1) / NOISE)
    near = F.lit(False)
    for b in BOUNDARIES:
        near = near | (F.abs(z - b) < NEAR)
    most = F.when(near & (F.col("_k") == FIRST), ALL).otherwise(FIRST)
    r = F.col("_b") / F.col("_a") - 1
    out = one.filter(F.col(sample) <= most).groupBy(*key).agg(
        F.count("*").alias("n_samples"), F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("std_return"), F.avg("_high").alias("predicted_max"), F.avg("_low").alias("predicted_min"), F.first("_start").alias("_start"),
    )
    return out.withColumn("predicted_range", (F.col("predicted_max") - F.col("predicted_min")) / F.col("_start")).drop("_start")


def top_k_top_p(df: DataFrame, group: list[str], logit: str, token: str, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """The tokens that may follow, with their share: the top_k greatest logits (0: all; ties with the last of them stay), then of these the fewest
    that together exceed top_p, the greatest always. Equal logits go by token."""
    w = Window.partitionBy(*group)
    down = w.orderBy(F.desc(logit), token)
    if top_k:
        df = df.withColumn("_k", F.rank().over(w.orderBy(F.desc(logit)))).filter(F.col("_k") <= top_k).drop("_k")
    weight = F.exp(F.col(logit) - F.max(logit).over(w))
    df = df.withColumn("_p", weight).withColumn("_p", F.col("_p") / F.sum("_p").over(w))
    before = F.coalesce(F.sum("_p").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_before", before).filter((F.col("_before") <= top_p) | (F.col("_before") == 0))
    return df.withColumn("share", F.col("_p") / F.sum("_p").over(w)).drop("_p", "_before")


def drawn(shares: DataFrame, group: list[str], token: str, draw: Column) -> DataFrame:
    """One token of each group: where a draw from [0, 1), constant in its group, falls among the running shares."""
    w = Window.partitionBy(*group).orderBy(F.desc("share"), token)
    upto = F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = shares.withColumn("_upto", upto).withColumn("_place", F.when(F.col("_upto") > draw, F.row_number().over(w)).otherwise(F.lit(1 << 30)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_place", F.desc("_upto"))))
    return rows.filter("_n = 1").drop("_upto", "_place", "_n")
