"""Exact quantiles of groups of any size: no task holds a group's values.

A window's median or percentile keeps a whole group in one task's memory. Here a sketch, whose size doesn't grow with the group, first brackets each quantile:
its error in rank is no more than 1 / `accuracy` of the group. One more aggregate counts the rows below each bracket and those of each value within
it; both are combined within tasks before they are shuffled. What is left of a group, about 4 / `accuracy` of its rows or fewer values where these
repeat, is ordered to find the values at the wanted ranks; so is a group of up to `accuracy` rows. Quantiles are interpolated as percentile() does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.ranks import bin_of, clip

ACCURACY = 100_000


def quantiles(df: DataFrame, x: str, group: list[str], shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """group and q: an array of the interpolated quantiles of x's known values; groups without one are left out. NaN counts as unknown."""
    value = F.col(x).cast("double")
    rows = df.select(*group, value.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    reach = 2.0 / accuracy
    around = [min(1.0, max(0.0, p + side * reach)) for p in shares for side in (-1, 1)]
    sketch = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_x", around, accuracy).alias("_a"))
    # A group that the sketch may not be finer than is bracketed whole.
    few = F.col("_n") <= accuracy
    low, high = (F.when(few, F.lit(side * float("inf"))) for side in (-1, 1))
    brackets = [F.struct(F.lit(i).alias("i"), low.otherwise(F.col("_a")[2 * i]).alias("low"), high.otherwise(F.col("_a")[2 * i + 1]).alias("high"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(shares)]
    sketch = sketch.select(*group, F.array(*brackets).alias("_b"))
    if group:
        placed = rows.join(sketch.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_b"), _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]))
    else:
        placed = rows.crossJoin(F.broadcast(sketch))  # one row
    # Of each bracket a row lies below (value NULL), within, or above, where it is of no account.
    counted = F.filter("_b", lambda b: F.col("_x") <= b["high"])
    met = placed.select(*group, "_x", F.explode(counted).alias("_k"))
    inside = F.when(F.col("_x") >= F.col("_k.low"), F.col("_x")).alias("_v")
    counts = met.groupBy(*group, F.col("_k.i").alias("_i"), F.col("_k.at").alias("_at"), inside).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group, "_i").orderBy(F.asc_nulls_first("_v"))
    upto = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda rank: F.min(F.when(F.col("_v").isNotNull() & (F.col("_upto") > rank), F.col("_v")))
    ends = upto.groupBy(*group, "_i", "_at").agg(pick(F.floor("_at")).alias("_low"), pick(F.ceil("_at")).alias("_high"))
    mixed = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    q = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(mixed)
    return ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", q.alias("_q")))).alias("_qs")).select(*group, F.transform("_qs", lambda s: s["_q"]).alias("q"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_quantiles(df: DataFrame, x: str, group: list[str], shares: list[float], name: str, accuracy: int = ACCURACY) -> DataFrame:
    """df with the array of its group's quantiles."""
    found = quantiles(df, x, group, shares, accuracy)
    if not group:
        return df.crossJoin(F.broadcast(found.withColumnRenamed("q", name)))  # one row
    named = found.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("q").alias(name))
    return df.join(named, _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]), "left").drop(*[f"_g_{g}" for g in group])


def winsorise_mad(df: DataFrame, x: str, group: list[str], k: float = 3.0, out: str | None = None) -> DataFrame:
    """panel.winsorise_mad() for groups of any size."""
    d = with_quantiles(df, x, group, [0.5], "_m").withColumn("_m", F.col("_m")[0])
    d = with_quantiles(d.withColumn("_far", F.abs(F.col(x) - F.col("_m"))), "_far", group, [0.5], "_d")
    reach = F.lit(k * 1.4826) * F.col("_d")[0]
    return d.withColumn(out or x, clip(x, F.col("_m") - reach, F.col("_m") + reach)).drop("_m", "_d", "_far")


def impute(df: DataFrame, x: str, group: list[str], default: float = 0.0, out: str | None = None) -> DataFrame:
    """ranks.impute() for groups of any size."""
    d = with_quantiles(df, x, group, [0.5], "_m")
    return d.withColumn(out or x, F.coalesce(F.col(x), F.col("_m")[0], F.lit(default))).drop("_m")


def qcut(df: DataFrame, x: str, bins: int, group: list[str], out: str) -> DataFrame:
    """Right-closed bins between a group's interpolated quantiles, for groups of any size."""
    shares = [i * (1 / bins) if i < bins else 1.0 for i in range(bins + 1)]
    d = with_quantiles(df, x, group, shares, "_e").withColumn("_e", F.array_distinct("_e"))
    return d.withColumn(out, bin_of(x, "_e")).drop("_e")
