"""Panels made of the tables, as DataFrames and as the same thing in SQL.

pm: supplier x month; pd: nation x day; fq: supplier x quarter, with the month from which it is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All doubles to some digits, so that engines agree."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date (first of the month), close, volume and cost of all lines, whether or not their supplier is known."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "MM").alias("date")).agg(
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), DIGITS).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("cost"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """months() of the suppliers that are known with their nation, and sector."""
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return months(spark, sf_dir).join(suppliers.select(F.col("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("sector")), "ticker")


MONTHS = """(
    select l_suppkey as ticker, cast(date_trunc('month', l_shipdate) as date) as date,
           round(sum(l_extendedprice) / sum(l_quantity), 6) as close, sum(l_quantity) as volume,
           round(sum(l_extendedprice * l_discount), 4) as cost
    from lineitem group by 1, 2)"""

PM = f"""pm as (
  select a.*, n.n_regionkey as sector from {MONTHS} a
  join supplier s on s.s_suppkey = a.ticker join nation n on n.n_nationkey = s.s_nationkey)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (nation), date, close, high, low, volume."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ticker"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(suppliers, "l_suppkey").groupBy("ticker", "date").agg(
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), DIGITS).alias("close"),
        F.round(F.max(unit), DIGITS).alias("high"),
        F.round(F.min(unit), DIGITS).alias("low"),
        F.sum("l_quantity").alias("volume"),
    )


PD = """pd as (
  select s_nationkey as ticker, cast(l_shipdate as date) as date,
         round(sum(l_extendedprice) / sum(l_quantity), 6) as close, round(max(l_extendedprice / l_quantity), 6) as high,
         round(min(l_extendedprice / l_quantity), 6) as low, sum(l_quantity) as volume
  from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)"""


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, quarter, revenue, cost, quantity and known: two months after the quarter's end."""
    q = F.trunc("l_shipdate", "quarter")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), q.alias("quarter")).agg(
        F.round(F.sum("l_extendedprice"), 4).alias("revenue"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("cost"),
        F.sum("l_quantity").alias("quantity"),
    ).withColumn("known", F.add_months(F.last_day(F.add_months("quarter", 2)), 2))


FQ = """fq as (
  select *, cast(last_day(cast(quarter + interval 2 month as date)) + interval 2 month as date) as known from (
    select l_suppkey as ticker, cast(date_trunc('quarter', l_shipdate) as date) as quarter,
           round(sum(l_extendedprice), 4) as revenue, round(sum(l_extendedprice * l_discount), 4) as cost, sum(l_quantity) as quantity
    from lineitem group by 1, 2))"""

#: Tie-average rank over the values of a group, as SQL text.
RANK = "(rank() over (partition by {g} order by {x} nulls last) + (count({x}) over (partition by {g}, {x}) - 1) / 2.0)"


def rank_sql(x: str, *group: str) -> str:
    return f"case when {x} is not null then {RANK.format(x=x, g=', '.join(group))} end"


def pct_sql(x: str, *group: str) -> str:
    return f"case when {x} is not null then {RANK.format(x=x, g=', '.join(group))} / count({x}) over (partition by {', '.join(group)}) end"
