"""Registered queries on series of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import windows as w_
from tidelens.operators import panel, scan
from tidelens.plans.panels import PD, PM, daily, monthly, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _returns(df: DataFrame) -> DataFrame:
    return df.withColumn("r", w_.momentum("close", w_.series(), 1))


RET = "ret as (select *, close / lag(close) over w - 1 as r from pd window w as (partition by ticker order by date))"


@query(f"""with {PM} select ticker, date,
  {", ".join(f"round(close / lag(close, {n}) over w - 1, 6) as mom_{n}" for n in (1, 3, 6, 12))}
from pm window w as (partition by ticker order by date)""")
def momentum_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir).select("ticker", "date", *[w_.momentum("close", w_.series(), n).alias(f"mom_{n}") for n in (1, 3, 6, 12)]))


@query(f"with {PM} select ticker, date, round(lag(close, 1) over w / lag(close, 12) over w - 1, 6) as mom_12_1 from pm window w as (partition by ticker order by date)")
def momentum_12_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly(spark, sf_dir).select("ticker", "date", w_.momentum("close", w_.series(), 12, skip=1).alias("mom_12_1")))


@query(f"""with {PD}, {RET} select ticker, date,
  round(case when count(r) over w20 >= 16 then stddev_samp(r) over w20 * sqrt(252) end, 3) as vol_20,
  round(case when count(r) over w60 >= 30 then stddev_samp(r) over w60 * sqrt(252) end, 3) as vol_60,
  round(case when count(r) over w60 >= 60 then stddev_samp(r) over w60 end, 3) as vol_60_raw
from ret window w20 as (partition by ticker order by date rows 19 preceding), w60 as (partition by ticker order by date rows 59 preceding)""")
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(daily(spark, sf_dir))
    return rounded(r.select("ticker", "date", w_.volatility("r", w_.series(), 20).alias("vol_20"), w_.volatility("r", w_.series(), 60).alias("vol_60"), w_.volatility("r", w_.series(), 60, 60, None).alias("vol_60_raw")), 3)


@query(f"""with {PD} select ticker, date,
  {", ".join(f"round(case when count(close) over w{n} >= {n // 2} then close / avg(close) over w{n} - 1 end, 6) as bias_{n}" for n in (20, 60, 120))}
from pd window {", ".join(f"w{n} as (partition by ticker order by date rows {n - 1} preceding)" for n in (20, 60, 120))}""")
def ma_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily(spark, sf_dir).select("ticker", "date", *[w_.bias("close", w_.series(), n).alias(f"bias_{n}") for n in (20, 60, 120)]))


@query(f"""with {PD} select ticker, date,
  round(case when count(close) over w20 >= 10 then avg((high - low) / close) over w20 end, 6) as amplitude_20,
  round(case when count(volume) over w20 >= 20 then avg(volume) over w20 end, 6) as turnover_20,
  round(case when count(volume) over w60 >= 30 then avg(volume) over w5 / avg(volume) over w60 end, 6) as volume_ratio,
  round(avg(close) over w5 / close, 6) as ma_5, round(avg(close) over w20 / close, 6) as ma_20
from pd window w5 as (partition by ticker order by date rows 4 preceding), w20 as (partition by ticker order by date rows 19 preceding), w60 as (partition by ticker order by date rows 59 preceding)""")
def range_and_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("spread", w_.ratio(F.col("high") - F.col("low"), "close"))
    return rounded(d.select(
        "ticker", "date",
        w_.frame(F.avg, "spread", w_.series(), 20, 10).alias("amplitude_20"),
        w_.frame(F.avg, "volume", w_.series(), 20).alias("turnover_20"),
        w_.ratio(w_.frame(F.avg, "volume", w_.series(), 5, 1), w_.frame(F.avg, "volume", w_.series(), 60, 30)).alias("volume_ratio"),
        w_.ratio(w_.frame(F.avg, "close", w_.series(), 5, 1), "close").alias("ma_5"),
        w_.ratio(w_.frame(F.avg, "close", w_.series(), 20, 1), "close").alias("ma_20"),
    ))


@query(f"""with {PD}, d as (select *, close - lag(close) over (partition by ticker order by date) as step from pd),
s as (select *, {", ".join(f"case when count(step) over w{n} >= {n // 2} then avg(greatest(step, 0)) over w{n} end as gain_{n}, case when count(step) over w{n} >= {n // 2} then avg(-least(step, 0)) over w{n} end as loss_{n}" for n in (14, 28))}
  from (select * from d) window {", ".join(f"w{n} as (partition by ticker order by date rows {n - 1} preceding)" for n in (14, 28))})
select ticker, date, {", ".join(f"round(case when loss_{n} = 0 then 100.0 else 100 - 100 / (1 + gain_{n} / loss_{n}) end, 6) as rsi_{n}" for n in (14, 28))} from s""".replace("greatest(step, 0)", "case when step is null then null else greatest(step, 0) end").replace("-least(step, 0)", "case when step is null then null else -least(step, 0) end"))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("step", F.col("close") - F.lag("close").over(w_.series()))
    return rounded(d.select("ticker", "date", *[w_.rsi("step", w_.series(), n).alias(f"rsi_{n}") for n in (14, 28)]))


@query(f"""with {PD}, b as (select *, case when count(close) over w >= 10 then avg(close) over w end as m, case when count(close) over w >= 10 then stddev_samp(close) over w end as s
  from pd window w as (partition by ticker order by date rows 19 preceding))
select ticker, date, round(4 * s / nullif(m, 0), 6) as boll_width, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) as boll_b from b""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, place = w_.bollinger("close", w_.series())
    return rounded(daily(spark, sf_dir).select("ticker", "date", width.alias("boll_width"), place.alias("boll_b")))


@query(f"""with recursive {PD}, k as (select *, row_number() over (partition by ticker order by date) as k from pd),
e as (
  select ticker, date, k, close as fast, close as slow, 0.0::double as signal from k where k = 1
  union all
  select k.ticker, k.date, k.k, e.fast * (1 - 2.0 / 13) + k.close * (2.0 / 13), e.slow * (1 - 2.0 / 27) + k.close * (2.0 / 27),
    e.signal * 0.8 + 0.2 * ((e.fast * (1 - 2.0 / 13) + k.close * (2.0 / 13)) - (e.slow * (1 - 2.0 / 27) + k.close * (2.0 / 27)))
  from e join k on k.ticker = e.ticker and k.k = e.k + 1)
select ticker, date, round((fast - slow) / close, 6) as macd, round(signal / close, 6) as macd_signal, round((fast - slow - signal) / close, 6) as macd_hist from e join k using (ticker, date)""")
def ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scan.ewm(daily(spark, sf_dir).select("ticker", "date", "close"), {"fast": ("close", 12), "slow": ("close", 26)}, gaps={"macd_signal": ("fast", "slow", 9)})
    e = e.withColumn("macd", F.col("fast") - F.col("slow")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return rounded(e.select("ticker", "date", *[w_.ratio(c, "close").alias(c) for c in ("macd", "macd_signal", "macd_hist")]))


@query(f"""with {PD}, {RET} select ticker, date,
  {", ".join(f"round(lead(close, {n}) over w / close - 1, 6) as fwd_{n}" for n in (5, 20, 60))},
  round(case when count(r) over f5 = 5 then stddev_samp(r) over f5 end, 6) as fwd_vol_5,
  round(case when count(close) over g5 = 6 then (max(high) over g5 - min(low) over g5) / close end, 6) as fwd_range_5
from ret window w as (partition by ticker order by date), f5 as (partition by ticker order by date rows between 1 following and 5 following), g5 as (partition by ticker order by date rows between current row and 5 following)""")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(daily(spark, sf_dir))
    return rounded(r.select(
        "ticker", "date", *[w_.forward("close", w_.series(), n).alias(f"fwd_{n}") for n in (5, 20, 60)],
        w_.ahead(F.stddev_samp, "r", w_.series(), 1, 5).alias("fwd_vol_5"),
        w_.ratio(w_.ahead(F.max, "high", w_.series(), 0, 5) - w_.ahead(F.min, "low", w_.series(), 0, 5), "close").alias("fwd_range_5"),
    ))


@query(f"with {PD} select ticker, date, close from (select *, row_number() over (partition by ticker, date_trunc('month', date) order by date desc) as k from pd) where k = 1")
def month_end_last_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.last_of_month(daily(spark, sf_dir)).select("ticker", "date", "close")


@query(f"""with {PD}, m as (select ticker, last_day(date) as month_end, arg_max(close, date) as close from pd group by 1, 2),
span as (select ticker, min(month_end) as a, max(month_end) as b from m group by 1),
spine as (select ticker, last_day(cast(unnest(generate_series(date_trunc('month', a)::timestamp, date_trunc('month', b)::timestamp, interval 1 month)) as date)) as month_end from span)
select ticker, month_end, close from spine left join m using (ticker, month_end)""")
def resample_month_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.resample_month(daily(spark, sf_dir), "close")


INDEX = """ix as (select date, round(sum(close * volume) / sum(volume), 6) as close from pd group by 1),
iv as (select *, close / lag(close) over (order by date) - 1 as r from ix)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a date: small enough for a window without a partition."""
    ix = daily(spark, sf_dir).groupBy("date").agg(F.round(F.sum(F.col("close") * F.col("volume")) / F.sum("volume"), 6).alias("close"))
    return ix.withColumn("ticker", F.lit("index"))


@query(f"""with {PD}, {INDEX}, v as (select *, stddev_samp(r) over w20 * sqrt(252) * 100 as vix, avg(close) over w200 as ma, count(close) over w200 as n,
  lag(close) over w as prev, lag(case when n250 >= 250 then ma250 end) over w as prev_ma
  from (select *, avg(close) over (order by date rows 249 preceding) as ma250, count(close) over (order by date rows 249 preceding) as n250 from iv)
  window w as (order by date), w20 as (order by date rows 19 preceding), w200 as (order by date rows 199 preceding))
select date, round(vix, 4) as vix, case when vix > 105 then 'Volatile' when n < 200 then 'Neutral' when close < ma then 'Bear' when close > ma and vix < 85 then 'Bull' else 'Neutral' end as regime,
  case when prev > prev_ma then 1 else 0 end as regime_lagged from v""")
def regime_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bull over the 200-row mean with low volatility, Bear under it, Volatile before all else; and yesterday's close over yesterday's 250-row mean."""
    ix = _index(spark, sf_dir).withColumn("r", w_.momentum("close", w_.series(), 1))
    ma, vix = w_.frame(F.avg, "close", w_.series(), 200), F.stddev_samp("r").over(w_.series().rowsBetween(-19, 0)) * F.sqrt(F.lit(252.0)) * 100
    ix = ix.select("date", "close", vix.alias("vix"), ma.alias("ma"), F.lag("close").over(w_.series()).alias("prev"), F.lag(w_.frame(F.avg, "close", w_.series(), 250)).over(w_.series()).alias("prev_ma"))
    regime = F.when(F.col("vix") > 105, "Volatile").when(F.col("close") < F.col("ma"), "Bear").when((F.col("close") > F.col("ma")) & (F.col("vix") < 85), "Bull").otherwise("Neutral")
    return rounded(ix.select("date", "vix", regime.alias("regime"), F.when(F.col("prev") > F.col("prev_ma"), 1).otherwise(0).alias("regime_lagged")), 4)


@query(f"""with {PM}, r as (select *, close / lag(close) over (partition by ticker order by date) - 1 as r from pm),
m as (select date, round(avg(r), 8) as r from r where r is not null group by 1),
n as (select *, exp(sum(ln(1 + r)) over (order by date)) as nav from m)
select date, r, round(nav, 6) as nav, round(nav / max(nav) over (order by date) - 1, 6) as drawdown from n""")
def nav_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the equally weighted panel; returns stay far from -100 %, so the SQL may take logarithms."""
    r = monthly(spark, sf_dir).withColumn("r", w_.momentum("close", w_.series(), 1)).groupBy("date").agg(F.round(F.avg("r"), 8).alias("r")).filter("r is not null")
    all_dates = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a date
    r = r.withColumn("nav", w_.nav("r", all_dates))
    return r.select("date", "r", F.round("nav", 6).alias("nav"), F.round(w_.drawdown("nav", all_dates), 6).alias("drawdown"))


@query(f"""with {PD}, s as (select *, count(*) over w as n, avg(close) over w50 as sma_50, avg(volume * close) over w14 / avg(volume) over w14 as vwma_14,
  greatest(high - low, abs(high - lag(close) over w1), abs(low - lag(close) over w1)) as tr, (high + low + close) / 3 as tp,
  lag((high + low + close) / 3) over w1 as tp0 from pd
  window w as (partition by ticker order by date rows unbounded preceding), w1 as (partition by ticker order by date), w14 as (partition by ticker order by date rows 13 preceding), w50 as (partition by ticker order by date rows 49 preceding)),
m as (select *, case when tp > tp0 then tp * volume else 0 end as up, case when tp < tp0 then tp * volume else 0 end as down from s)
select ticker, date, round(case when n >= 50 then sma_50 / close end, 6) as sma_50, round(case when n >= 14 then vwma_14 / close end, 6) as vwma_14,
  round(case when n >= 14 then avg(tr) over w14 / close end, 6) as atr_14,
  round(case when n >= 14 then 100 * sum(up) over w14 / nullif(sum(up) over w14 + sum(down) over w14, 0) end, 6) as mfi_14
from m window w14 as (partition by ticker order by date rows 13 preceding)""")
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, volume-weighted average and true range over the close, and money flow, by their textbook forms."""
    d, last = daily(spark, sf_dir), F.lag("close").over(w_.series())
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = d.withColumns({"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)), "tp": typical, "pv": F.col("close") * F.col("volume"), "n": F.row_number().over(w_.series())})
    before = F.lag("tp").over(w_.series())
    flow = F.col("tp") * F.col("volume")
    d = d.withColumns({"up": F.when(F.col("tp") > before, flow).otherwise(0.0), "down": F.when(F.col("tp") < before, flow).otherwise(0.0)})
    f14 = w_.series().rowsBetween(-13, 0)
    full = F.col("n") >= 14
    up, down = F.sum("up").over(f14), F.sum("down").over(f14)
    return rounded(d.select(
        "ticker", "date", w_.ratio(w_.frame(F.avg, "close", w_.series(), 50), "close").alias("sma_50"),
        F.when(full, w_.ratio(w_.ratio(F.avg("pv").over(f14), F.avg("volume").over(f14)), "close")).alias("vwma_14"),
        F.when(full, w_.ratio(F.avg("tr").over(f14), "close")).alias("atr_14"), F.when(full, w_.ratio(100 * up, up + down)).alias("mfi_14"),
    ))


@query(f"""with {PD}, k as (select *, row_number() over (partition by ticker order by date) as k from pd),
g as (select *, regr_slope(close, k) over w as slope, regr_intercept(close, k) over w as base, count(*) over w as n from k window w as (partition by ticker order by date rows 19 preceding))
select ticker, date, round((base + slope * (k + h)) / close, 6) as forecast, h from g, (values (1), (5)) v(h) where n = 20""")
def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through the last 20 rows, 1 and 5 rows on, over the close."""
    d = daily(spark, sf_dir).withColumn("k", F.row_number().over(w_.series()))
    f = w_.series().rowsBetween(-19, 0)
    d = d.select("ticker", "date", "close", "k", F.regr_slope("close", "k").over(f).alias("slope"), F.regr_intercept("close", "k").over(f).alias("base"), F.count("*").over(f).alias("n")).filter("n = 20")
    d = d.select("*", F.explode(F.array(F.lit(1), F.lit(5))).alias("h"))
    return rounded(d.select("ticker", "date", w_.ratio(F.col("base") + F.col("slope") * (F.col("k") + F.col("h")), "close").alias("forecast"), "h"))


@query(f"with {PD} select ticker, count(*) as n from pd group by 1 having count(*) >= 252")
def long_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.long_enough(daily(spark, sf_dir), 252).groupBy("ticker").agg(F.count("*").alias("n"))


@query("""with d as (select distinct cast(ts as date) as date from events)
select date, (select max(b) from (select unnest(generate_series(date::timestamp, date::timestamp + interval 6 day, interval 1 day)) as b) where extract(isodow from b) < 6 and b < date::timestamp + interval 5 day)::date as last_business_day,
  cast(date + interval 33 day as date) as after_20_trading_days from d""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last business day of the five days from a date, and the calendar day 20 trading days on (n * 7 // 5 + 5 days)."""
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    days = F.filter(F.sequence("date", F.date_add("date", 4)), lambda x: F.weekday(x) < 5)
    return d.select("date", F.array_max(days).alias("last_business_day"), F.date_add("date", 20 * 7 // 5 + 5).alias("after_20_trading_days"))
