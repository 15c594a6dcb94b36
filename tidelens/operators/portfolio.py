"""Portfolios from scores, their returns, and statistics of returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.windows import nav, ratio


def rank_universe(df: DataFrame, score: str, group: list[str], top: float = 0.3, bottom: float = 0.3, entity: str = "ticker") -> DataFrame:
    """direction, strength and percentile by score (0 to 100): the first share is bought, the last sold, the rest held; without a score HOLD, 0 and 0.5. BUY wins where shares overlap."""
    w = Window.partitionBy(*group)
    s = F.col(score)
    n = F.count(s).over(w)
    df = df.withColumn("_k", F.row_number().over(w.orderBy(s.desc_nulls_last(), entity)) - 1).withColumn("_n", n)
    first, last = (F.greatest(F.lit(1), F.floor(F.col("_n") * x)) for x in (top, bottom))
    direction = F.when(s.isNull(), "HOLD").when(F.col("_k") < first, "BUY").when(F.col("_k") >= F.col("_n") - last, "SELL").otherwise("HOLD")
    df = df.withColumn("direction", direction)
    strength = F.when(F.col("direction") == "BUY", 0.5 + 0.5 * s / 100).when(F.col("direction") == "SELL", 0.5 + 0.5 * (1 - s / 100)).otherwise(0.0)
    return df.withColumn("strength", F.least(F.lit(1.0), strength)).withColumn("percentile", F.when(s.isNull(), 0.5).otherwise(1 - F.col("_k") / F.col("_n"))).drop("_k", "_n")


def held_returns(held: DataFrame, prices: DataFrame, dates: DataFrame, entity: str = "ticker", date: str = "date", price: str = "close") -> DataFrame:
    """The return of every held row until the next of `dates`; what has no price there has lost everything.

    held: entity, date, price. prices: entity, date, price. dates: one row a rebalancing date, with `next_date`.
    """
    then = prices.select(entity, F.col(date).alias("next_date"), F.col(price).alias("_then"))
    out = held.join(F.broadcast(dates), date).filter("next_date is not null").join(then, [entity, "next_date"], "left")
    return out.withColumn("ret", F.coalesce(ratio("_then", price) - 1, F.lit(-1.0))).drop("_then")


def held_to_next(held: DataFrame, dates: DataFrame, date: str = "date", price: str = "close") -> DataFrame:
    """held_returns() for rows that know their entity's next row (next_row, next_close) on a panel whose dates are all rebalancing dates: no join of prices.

    A next row that comes later than the next date means that the entity had no price there.
    """
    out = held.join(F.broadcast(dates), date).filter("next_date is not null")
    then = F.when(F.col("next_row") == F.col("next_date"), F.col("next_close"))
    return out.withColumn("ret", F.coalesce(ratio(then, price) - 1, F.lit(-1.0))).drop("next_row", "next_close")


def rebalance_dates(df: DataFrame, step: int = 1, date: str = "date") -> DataFrame:
    """Every step-th date with the next one, and its number. One row a date."""
    one = Window.orderBy(date)
    kept = df.select(date).distinct().withColumn("_k", F.row_number().over(one) - 1).filter(F.col("_k") % step == 0)
    return kept.select(date, F.lead(date).over(one).alias("next_date"), (F.row_number().over(one) - 1).alias("turn"))


def overlap(members: DataFrame, least: int, entity: str = "ticker", turn: str = "turn") -> DataFrame:
    """turn, kept and turnover against the turn before; turns with `least` members or fewer drop out. members: one row a turn and entity."""
    sizes = members.groupBy(turn).agg(F.count("*").alias("n"))
    before = members.select(entity, (F.col(turn) + 1).alias(turn))
    same = members.join(before, [entity, turn], "left_semi").groupBy(turn).agg(F.count("*").alias("same"))
    first = sizes.select((F.col(turn) + 1).alias(turn), F.col("n").alias("n_before"))
    out = sizes.join(first, turn).join(same, turn, "left").filter((F.col("n") > least) & (F.col("n_before") > least))
    kept = F.coalesce(F.col("same"), F.lit(0)) / F.col("n")
    return out.select(turn, kept.alias("kept"), (1 - kept).alias("turnover"))


def full_stats(df: DataFrame, ret: str, group: list[str], date: str = "date", year: float = 12.0) -> DataFrame:
    """n, mean, win_rate, deviation, sharpe, t_stat, max_drawdown (positive, the curve starts at 1), n_up and n_down of each group's returns."""
    r = F.col(ret)
    w = Window.partitionBy(*group).orderBy(date)
    curve = df.filter(r.isNotNull()).withColumn("_nav", nav(r, w))
    top = F.greatest(F.lit(1.0), F.max("_nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    curve = curve.withColumn("_fall", (top - F.col("_nav")) / top)
    out = curve.groupBy(*group).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.stddev_samp(r).alias("deviation"),
        F.greatest(F.lit(0.0), F.max("_fall")).alias("max_drawdown"), F.count_if(r > 0).alias("n_up"), F.max_by("_nav", date).alias("nav"),
    )
    real = F.col("deviation") > 1e-9
    return out.withColumns({
        "deviation": F.coalesce("deviation", F.lit(0.0)),
        "sharpe": F.when(real, F.col("mean") / F.col("deviation") * F.sqrt(F.lit(year))),
        "t_stat": F.when(real, F.col("mean") / (F.col("deviation") / F.sqrt("n"))),
        "n_down": F.col("n") - F.col("n_up"),
    })


def nav_sharpe(df: DataFrame, ret: str, group: list[str], date: str = "date", year: float = 12.0) -> DataFrame:
    """n and sharpe of the changes of each group's compounded curve; its first date has no change and drops out."""
    w = Window.partitionBy(*group).orderBy(date)
    curve = df.filter(F.col(ret).isNotNull()).withColumn("_nav", nav(ret, w))
    change = ratio(F.col("_nav"), F.lag("_nav").over(w)) - 1
    out = curve.withColumn("_c", change).groupBy(*group).agg(F.count("_c").alias("n"), F.avg("_c").alias("_m"), F.stddev_samp("_c").alias("_s"))
    return out.select(*group, "n", (F.sqrt(F.lit(year)) * ratio("_m", "_s")).alias("sharpe"))


def valid(direction: str | Column = "direction", z: str | Column = "z", error: str | Column = "error") -> Column:
    """Whether a signal may be traded: it says to buy or to sell, has a z, and no error."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(at(direction).isin("BUY", "SELL"), F.lit(False)) & at(z).isNotNull() & (F.coalesce(at(error), F.lit("")) == "")


def long_short(df: DataFrame, side: Column, ret: str, group: list[str]) -> DataFrame:
    """long, short (means of the rows whose side is 1 or -1), their numbers, and the spread if both have rows."""
    out = df.withColumn("_s", side).groupBy(*group).agg(
        F.avg(F.when(F.col("_s") == 1, F.col(ret))).alias("long"), F.avg(F.when(F.col("_s") == -1, F.col(ret))).alias("short"),
        F.count_if(F.col("_s") == 1).alias("n_long"), F.count_if(F.col("_s") == -1).alias("n_short"),
    )
    return out.withColumn("spread", F.col("long") - F.col("short"))


def strength_gains(df: DataFrame, direction: str, strength: str, ret: str, active: float = 0.1, date: str = "date", digits: int = 9) -> DataFrame:
    """date, n, ret, nav and win_rate: each row gains its strength times the return, or the opposite for a SELL; dates take the mean.

    win_rate is the number of gains over the rows with a strength above `active`, of all dates: so defined, the two sets differ.
    """
    rows = df.filter(F.col(strength).isNotNull() & F.col(ret).isNotNull())
    gain = F.when(F.col(direction) == "BUY", F.col(strength) * F.col(ret)).when(F.col(direction) == "SELL", -F.col(strength) * F.col(ret)).otherwise(0.0)
    days = rows.withColumn("_g", F.round(gain, digits)).groupBy(date).agg(
        F.count("*").alias("n"), F.round(F.avg("_g"), digits).alias("ret"), F.count_if(F.col("_g") > 0).alias("_up"), F.count_if(F.col(strength) > active).alias("_active"),
    )
    every = Window.partitionBy(F.lit(1))  # one row a date
    win = ratio(F.sum("_up").over(every), F.sum("_active").over(every))
    return days.select(date, "n", "ret", nav("ret", every.orderBy(date)).alias("nav"), win.alias("win_rate"))
