"""Registered queries of rules on single rows, of tables as such, and of retrieval."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import scoring
from tidelens.functions import windows as w_
from tidelens.operators import panel, retrieval
from tidelens.plans.panels import DIGITS, PD, PM, daily, monthly, rounded, table
from tidelens.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: How much each analyst's report weighs. Fixed values.
ANALYST_WEIGHTS = {"bull_researcher": 1.5, "bear_researcher": 1.5, "market": 1.0, "social": 0.8, "news": 1.0, "fundamentals": 1.2}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIGURES = {
    "pe": "round(s_acctbal / 150, 4)", "pb": "(s_suppkey % 7) + 0.5D", "cr": "0.3D + (s_suppkey % 20) / 10D", "de": "case when s_suppkey % 11 <> 0 then (s_suppkey % 45) / 10D end",
    "pm": "((s_suppkey % 40) - 10) / 100D", "roe": "case when s_suppkey % 13 <> 0 then ((s_suppkey % 30) - 5) / 100D end", "cap": "(s_suppkey % 250) * 1000000000D", "ret": "((s_suppkey % 90) - 30) / 100D",
    "beta": "((s_suppkey % 25) - 2) / 10D", "z": "((s_suppkey % 61) - 30) / 10D", "doubt": "(s_suppkey % 90) / 1000D", "sentiment": "((s_suppkey % 21) - 10) / 10D", "risk": "(s_suppkey % 11) / 10D",
}


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up figures of each supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), *[F.expr(x).alias(k) for k, x in _FIGURES.items()])


_D = re.compile(r"(\d(?:\.\d+)?)D\b")
ST = "st as (select s_suppkey as ticker, " + ", ".join(f"{_D.sub(lambda m: m[1] + '::double', x)} as {k}" for k, x in _FIGURES.items()) + " from supplier)"


def _small(x: str, sweet: float, worst: float) -> str:
    return f"case when {x} is null then 50.0 when {x} <= {sweet} then 100.0 else greatest(0, least(100, 100 * exp(-1.5 / ({worst} - {sweet}) * ({x} - {sweet})))) end"


def _large(x: str, sweet: float, worst: float) -> str:
    return f"case when {x} is null then 50.0 else greatest(0, least(100, ({x} - ({worst})) / ({sweet} - ({worst})) * 100)) end"


SCORES = f"""{ST}, sc as (select *, 0.7 * (case when pe <= 0 then 0 else {_small('pe', 12, 45)} end) + 0.3 * ({_small('pb', 1.5, 5.0)}) as value_score,
  0.2 * ({_large('cr', 1.8, 0.5)}) + 0.3 * ({_small('coalesce(de, 0)', 0.5, 3.0)}) + 0.25 * ({_large('pm', 0.2, 0.0)}) + 0.25 * ({_large('roe', 0.15, 0.0)}) as quality_score,
  {_small('(cap / 1e9)', 2.0, 200.0)} as size_score, {_large('ret', 0.3, -0.2)} as momentum_score, case when beta < 0 then 50.0 else {_small('beta', 0.8, 2.0)} end as volatility_score from st),
so as (select *, 0.25 * value_score + 0.35 * quality_score + 0.2 * momentum_score + 0.1 * size_score + 0.1 * volatility_score as overall from sc)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """figures() with the five scores and their unrounded weighted sum."""
    d = figures(spark, sf_dir).withColumns({
        "value_score": scoring.value_score("pe", "pb"), "quality_score": scoring.quality_score("cr", "de", "pm", "roe"), "size_score": scoring.size_score("cap"),
        "momentum_score": scoring.momentum_score("ret"), "volatility_score": scoring.volatility_score("beta"),
    })
    c = F.col
    return d.withColumn("overall", 0.25 * c("value_score") + 0.35 * c("quality_score") + 0.2 * c("momentum_score") + 0.1 * c("size_score") + 0.1 * c("volatility_score"))


@query(f"with {SCORES} select ticker, {', '.join(f'round({c}, 6) as {c}' for c in ('value_score', 'quality_score', 'size_score', 'momentum_score', 'volatility_score', 'overall'))} from so")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir).select("ticker", "value_score", "quality_score", "size_score", "momentum_score", "volatility_score", "overall"))


_REGIME = "case when abs(z) > 2 and doubt < 0.05 then case when z > 0 then 'STRONG_TREND_UP' else 'STRONG_TREND_DOWN' end when doubt > 0.06 then 'HIGH_VOL' else 'RANGING_MIXED' end"


@query(f"""with {SCORES}, p as (select *, {_REGIME} as rg, tanh(abs(z)) * exp(-10 * greatest(0, doubt - 0.03)) as cap0 from so),
q as (select *, cap0 * case rg when 'HIGH_VOL' then 0.3 when 'RANGING_MIXED' then 0.7 else 1 end as cap1, coalesce(de, 0) > 3 and coalesce(cr, 1) < 0.8 as bust from p)
select ticker, case when bust then 'FUNDAMENTAL_BUST_OVERRIDE' else rg end as regime, case when bust then 'CRASH_SELL' when z > 0 then 'BUY' else 'SELL' end as direction,
  round(case when bust then 0 else least(1, greatest(0, least(1, cap1 * (1 + 0.3 * sentiment) * (1 - risk))) * (0.5 + overall / 100)) end, 6) as strength from q""")
def position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, bust = scores(spark, sf_dir), scoring.is_bust("de", "cr")
    return rounded(d.select(
        "ticker", F.when(bust, "FUNDAMENTAL_BUST_OVERRIDE").otherwise(scoring.signal_regime("z", "doubt")).alias("regime"),
        F.when(bust, "CRASH_SELL").when(F.col("z") > 0, "BUY").otherwise("SELL").alias("direction"),
        F.when(bust, 0.0).otherwise(scoring.position("z", "doubt", "sentiment", "risk", "overall")).alias("strength"),
    ))


@query(f"""with {ST} select ticker, case when z >= 0.5 then 'BUY' when z <= -0.5 then 'SELL' else 'HOLD' end as action,
  case when abs(z) < 0.5 then 'HOLD' else case when abs(z) < 1 then 'SMALL ' when abs(z) < 1.5 then 'MEDIUM ' else 'LARGE ' end || case when z > 0 then 'BULLISH' else 'BEARISH' end || ' POSITION' end as decision,
  round(case when abs(z) < 0.5 then 0.85 - 0.2 * (abs(z) / 0.5) when abs(z) < 1 then 0.6 + 0.1 * (abs(z) - 0.5) / 0.5 when abs(z) < 1.5 then 0.7 + 0.1 * (abs(z) - 1) / 0.5 else least(0.8 + 0.15 * (abs(z) - 1.5), 0.95) end, 6) as confidence,
  round(sentiment / greatest(doubt, 0.005), 6) as z_again from st""")
def confidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision, sure = scoring.confidence("z")
    return rounded(figures(spark, sf_dir).select("ticker", scoring.z_decision("z").alias("action"), decision.alias("decision"), sure.alias("confidence"), scoring.z_score("sentiment", "doubt").alias("z_again")))


@query(f"""with {SCORES}, w as (select ticker, coalesce(de, 0) > 3 and coalesce(cr, 1) < 0.8 as bust, greatest(0, overall) / (doubt + 0.005) as raw from so), s as (select sum(case when not bust then raw end) as total from w)
select ticker, case when bust then 'BUST' else 'OK' end as status, round(case when bust then 0 else raw / total end, 8) as weight from w, s""")
def risk_parity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir).select("ticker", scoring.is_bust("de", "cr").alias("bust"), scoring.raw_weight("overall", "doubt").alias("raw"))
    total = d.filter(~F.col("bust")).agg(F.sum("raw").alias("total"))  # one row
    return d.join(F.broadcast(total)).select("ticker", F.when(F.col("bust"), "BUST").otherwise("OK").alias("status"), F.round(F.when(F.col("bust"), 0.0).otherwise(F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0)), 8).alias("weight"))


@query(f"""with {PD}, l as (select * from pd where date = (select max(date) from pd)), g as (select ticker, close as base, unnest(generate_series(0, 8)) as level, high as top, low as bottom from l),
p as (select ticker, level, base, (top - bottom) / 8 as step, top - level * (top - bottom) / 8 as price from g)
select ticker, cast(level as int) as level, round(price / base, 5) as price, case when abs(price - base) < step * 0.5 then 'HOLD' when price > base then 'SELL' else 'BUY' end as action, round((price - base) / base, 6) as distance from p""")
def grid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine prices from the last day's high to its low, over the close, and what to do at each."""
    d = daily(spark, sf_dir)
    d = d.join(F.broadcast(d.agg(F.max("date").alias("date"))), "date")
    d = d.select("ticker", F.col("close").alias("base"), ((F.col("high") - F.col("low")) / 8).alias("step"), "high", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("level"))
    d = d.withColumn("price", F.col("high") - F.col("level") * F.col("step"))
    action = F.when(F.abs(F.col("price") - F.col("base")) < F.col("step") * 0.5, "HOLD").when(F.col("price") > F.col("base"), "SELL").otherwise("BUY")
    return d.select("ticker", "level", F.round(w_.ratio("price", "base"), 5).alias("price"), action.alias("action"), F.round(w_.ratio(F.col("price") - F.col("base"), "base"), 6).alias("distance"))


_ANALYSTS = ("bull_researcher", "bear_researcher", "market", "social", "news", "fundamentals")
REPORTS = f"""rep as (select user_id as ticker, analyst, round(avg(s), 6) as sentiment, round(avg(r), 6) as risk from (
  select user_id, [{', '.join(repr(a) for a in _ANALYSTS)}][cast(event_id % 6 as int) + 1] as analyst, round((value - 100) / 100, 6) as s, round(value / 400, 6) as r from events) group by 1, 2)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report of each analyst on each user, made of events."""
    e = table(spark, sf_dir, "events")
    who = F.element_at(F.array(*[F.lit(a) for a in _ANALYSTS]), (F.col("event_id") % 6).cast("int") + 1)
    e = e.select(F.col("user_id").alias("ticker"), who.alias("analyst"), F.round((F.col("value") - 100) / 100, 6).alias("s"), F.round(F.col("value") / 400, 6).alias("r"))
    return e.groupBy("ticker", "analyst").agg(F.round(F.avg("s"), 6).alias("sentiment"), F.round(F.avg("r"), 6).alias("risk"))


@query(f"""with {REPORTS}, w as (select unnest([{', '.join(repr(a) for a in ANALYST_WEIGHTS)}]) as analyst, unnest([{', '.join(f'{x}::double' for x in ANALYST_WEIGHTS.values())}]) as w),
c as (select ticker, round(sum(w * sentiment) / sum(w), 4) as sentiment, round(sum(w * risk) / sum(w), 4) as risk, avg(risk) as mean_risk, least(var_pop(sentiment), 1) as divergence from rep join w using (analyst) group by 1)
select ticker, sentiment, risk, case when sentiment > 0.2 then 'BULLISH' when sentiment < -0.2 then 'BEARISH' else 'NEUTRAL' end as label, round(divergence, 4) as divergence, round(least(mean_risk + 0.4 * divergence, 1), 4) as system_risk from c""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted consensus of the reports there are, and risk raised by how much they diverge."""
    w = spark.createDataFrame(list(ANALYST_WEIGHTS.items()), "analyst string, w double")
    mean = lambda x: F.round(F.sum(F.col("w") * F.col(x)) / F.sum("w"), 4)
    c = reports(spark, sf_dir).join(F.broadcast(w), "analyst").groupBy("ticker").agg(mean("sentiment").alias("sentiment"), mean("risk").alias("risk"), F.avg("risk").alias("mean_risk"), F.least(F.var_pop("sentiment"), F.lit(1.0)).alias("divergence"))
    label = F.when(F.col("sentiment") > 0.2, "BULLISH").when(F.col("sentiment") < -0.2, "BEARISH").otherwise("NEUTRAL")
    return rounded(c.select("ticker", "sentiment", "risk", label.alias("label"), "divergence", F.least(F.col("mean_risk") + 0.4 * F.col("divergence"), F.lit(1.0)).alias("system_risk")), 4)


@query("""select user_id as ticker, cast(ts as date) as date, count(*) as n, round(avg(round((value - 100) / 100, 6)), 6) as mean_score, round(avg(case when value > 120 then 1.0 else 0.0 end), 6) as bullish_share from events group by 1, 2""")
def sentiment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "value", F.round((F.col("value") - 100) / 100, 6).alias("s"))
    return rounded(e.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg(F.when(F.col("value") > 120, 1.0).otherwise(0.0)).alias("bullish_share")))


@query(f"""with {PD}, s as (select *, lead(close, 5) over w / close - 1 as r, close / lag(close) over w - 1 as m from pd window w as (partition by ticker order by date)), d as (select *, case when m > 0.1 then 'BUY' when m < -0.1 then 'SELL' else 'HOLD' end as direction from s where m is not null and r is not null)
select ticker, direction, count(*) as n, round(avg(case when (direction = 'BUY' and r > 0) or (direction = 'SELL' and r < 0) or (direction = 'HOLD' and abs(r) < 0.02) then 1.0 else 0.0 end), 6) as hit_rate,
  round(avg(case direction when 'BUY' then r when 'SELL' then -r else 0 end), 6) as pnl, round(case when not isnan(corr(m, r)) then corr(m, r) end, 5) as corr from d group by 1, 2""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows on: whether a signal was right (HOLD: less than 2 % either way) and what it gained."""
    w = w_.series()
    d = daily(spark, sf_dir).select("ticker", w_.forward("close", w, 5).alias("r"), w_.momentum("close", w, 1).alias("m")).filter("m is not null and r is not null")
    d = d.withColumn("direction", F.when(F.col("m") > 0.1, "BUY").when(F.col("m") < -0.1, "SELL").otherwise("HOLD"))
    hit = ((F.col("direction") == "BUY") & (F.col("r") > 0)) | ((F.col("direction") == "SELL") & (F.col("r") < 0)) | ((F.col("direction") == "HOLD") & (F.abs("r") < 0.02))
    gain = F.when(F.col("direction") == "BUY", F.col("r")).when(F.col("direction") == "SELL", -F.col("r")).otherwise(0.0)
    out = d.groupBy("ticker", "direction").agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(gain).alias("pnl"), w_.corr("m", "r").alias("corr"))
    return out.select("ticker", "direction", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("pnl", 6).alias("pnl"), F.round("corr", 5).alias("corr"))


@query(f"""with {ST}, s as (select round(avg(case when abs(z) > 0.5 then 1.0 else 0.0 end), 6) as active, round(avg(case when z > 0 then 1.0 else 0.0 end), 6) as up, round(avg(case when doubt is not null then 1.0 else 0.0 end), 6) as valid from st)
select *, case when valid < 0.8 then 'DATA' when up > 0.7 or up < 0.3 then 'BIASED' when active > 0.85 then 'OVERACTIVE' else 'HEALTHY' end as verdict from s""")
def signal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    s = figures(spark, sf_dir).agg(share(F.abs("z") > 0.5).alias("active"), share(F.col("z") > 0).alias("up"), share(F.col("doubt").isNotNull()).alias("valid"))
    return s.withColumn("verdict", F.when(F.col("valid") < 0.8, "DATA").when((F.col("up") > 0.7) | (F.col("up") < 0.3), "BIASED").when(F.col("active") > 0.85, "OVERACTIVE").otherwise("HEALTHY"))


@query(f"""with {PM}, t as (select *, lag(close, 12) over w as a, lead(close) over w as b from pm window w as (partition by ticker order by date))
{" union all ".join(f"select '{c}' as column, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as null_rate from t" for c in ("ticker", "close", "a", "b"))}""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = w_.series()
    return rounded(panel.null_rates(monthly(spark, sf_dir).select("ticker", "close", F.lag("close", 12).over(w).alias("a"), F.lead("close").over(w).alias("b"))))


@query(f"""with {PM}, t as (select *, round(lead(close) over w / close - 1, 10) as y, lead(close) over w as nx from pm window w as (partition by ticker order by date))
select count(*) as n, count(y) as labels, cast(count_if(abs(nx / close - 1 - y) > 1e-8) as bigint) as misaligned, round(avg(case when y is null then 1.0 else 0.0 end), 6) as null_rate, count(*) >= 3000 and avg(case when y is null then 1.0 else 0.0 end) <= 0.5 as passed from t""")
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels must equal the next close over the close, less 1, and enough rows must have one."""
    w = w_.series()
    t = monthly(spark, sf_dir).select("close", F.round(w_.forward("close", w), 10).alias("y"), F.lead("close").over(w).alias("nx"))
    missing = F.avg(F.when(F.col("y").isNull(), 1.0).otherwise(0.0))
    return t.agg(F.count("*").alias("n"), F.count("y").alias("labels"), F.count_if(F.abs(w_.ratio("nx", "close") - 1 - F.col("y")) > 1e-8).alias("misaligned"), F.round(missing, 6).alias("null_rate"), ((F.count("*") >= 3000) & (missing <= 0.5)).alias("passed"))


@query("select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), DIGITS).alias("share"))


@query(f"with {PM} select sector, count(close) as n, round(avg(close), 2) as mean, round(stddev_samp(close), 2) as std, min(close) as min, round(quantile_cont(close, 0.25), 2) as q25, round(quantile_cont(close, 0.5), 2) as q50, round(quantile_cont(close, 0.75), 2) as q75, max(close) as max, count(distinct ticker) as tickers from pm group by 1")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("close", F.lit(p)), 2)
    return monthly(spark, sf_dir).groupBy("sector").agg(
        F.count("close").alias("n"), F.round(F.avg("close"), 2).alias("mean"), F.round(F.stddev_samp("close"), 2).alias("std"), F.min("close").alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("close").alias("max"), F.count_distinct("ticker").alias("tickers"),
    )


@query(f"""with {PM}, q as (select ticker, strftime(date, '%Y-%m-%d') as d, close from pm) pivot q on d using coalesce(first(close), 0) group by ticker""")
def pivot_slicer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field as a matrix of tickers and all dates; what is missing is 0."""
    return panel.slicer(monthly(spark, sf_dir), "close")


@query("""with c as (select upper(c_name) as t, lpad(c_custkey::varchar, 10, '0') as cik from customer)
select o_orderpriority, count(*) as n, count(cik) as known, min(cik) as first, max(cik) as last from orders join customer on c_custkey = o_custkey left join c on t = upper(c_name) group by 1""")
def ticker_cik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the numbers that their customers' names have in a lookup."""
    c = table(spark, sf_dir, "customer")
    lookup = c.select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik_str"))
    orders = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.lower("c_name").alias("ticker")), "o_custkey")
    found = readers.with_cik(orders.select("o_orderpriority", "ticker"), lookup)
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("cik").alias("known"), F.min("cik").alias("first"), F.max("cik").alias("last"))


@query(f"""with {PD}, old as (select ticker, date, close, 0 as batch from pd where extract(day from date) <= 20), new as (select ticker, date, close * 2 as close, 1 as batch from pd where extract(day from date) >= 10),
k as (select *, row_number() over (partition by ticker, date order by batch desc) as k, row_number() over (partition by ticker, date order by batch) as j from (select * from old union all select * from new))
select ticker, count(*) as n, cast(count_if(k = 1) as bigint) as kept, cast(round(sum(case when k = 1 then cast(close as decimal(18, 6)) end), 2) as double) as new_wins, cast(round(sum(case when j = 1 then cast(close as decimal(18, 6)) end), 2) as double) as old_wins from k group by 1""")
def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches that overlap, with the newer or the older row winning."""
    d = daily(spark, sf_dir).select("ticker", "date", "close")
    old, new = d.filter(F.dayofmonth("date") <= 20), d.filter(F.dayofmonth("date") >= 10).withColumn("close", F.col("close") * 2)
    n = old.unionByName(new).groupBy("ticker").agg(F.count("*").alias("n"))
    total = F.round(F.sum(F.col("close").cast("decimal(18,6)")), 2).cast("double")  # exact, or engines round ties apart
    a = panel.upsert(old, new, ["ticker", "date"]).groupBy("ticker").agg(F.count("*").alias("kept"), total.alias("new_wins"))
    b = panel.upsert(old, new, ["ticker", "date"], new_wins=False).groupBy("ticker").agg(total.alias("old_wins"))
    return n.join(a, "ticker").join(b, "ticker")


@query("""select c_custkey, case when c_custkey % 2 = 0 then lpad(c_custkey::varchar, 6, '0') || '.SS' else lpad(c_custkey::varchar, 6, '0') || '.SZ' end as code,
  case when c_custkey % 2 = 0 then 'sh.' else 'sz.' end || lpad(c_custkey::varchar, 6, '0') as local, lpad(c_custkey::varchar, 10, '0') as cik from customer""")
def ticker_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    d = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "sh.").otherwise("sz."), number).alias("given"))
    d = d.withColumn("code", scoring.exchange_code("given"))
    return d.select("c_custkey", "code", scoring.local_code("code").alias("local"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as file_name from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_").alias("file_name"))


@query("""with m as (select event_id, 'note' || chr(10) || '```json' || chr(10) || case when event_id % 4 = 0 then '{"other": 1}' else '{"market_sentiment": ' || cast(event_id % 10 as varchar) || '.5}' end || chr(10) || '```' as text from events)
select event_id, case when event_id % 4 = 0 then 0.0 else (event_id % 10) + 0.5 end as market_sentiment, 0.5 as risk_factor from m""".replace("0.5 as risk_factor", "0.5::double as risk_factor").replace("then 0.0 else (event_id % 10) + 0.5 end", "then 0.0::double else (event_id % 10) + 0.5::double end"))
def fenced_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures out of fenced JSON in free text; what is missing gets its default."""
    body = F.when(F.col("event_id") % 4 == 0, '{"other": 1}').otherwise(F.concat(F.lit('{"market_sentiment": '), (F.col("event_id") % 10).cast("string"), F.lit(".5}")))
    d = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("note\n```json\n"), body, F.lit("\n```")).alias("text"))
    found = scoring.fenced_json("text", "market_sentiment double, risk_factor double", {"market_sentiment": 0.0, "risk_factor": 0.5})
    return d.select("event_id", found.alias("x")).select("event_id", "x.*")


@query("select event_id, cast(extract(minute from ts) as int) as minute, cast(extract(hour from ts) as int) as hour, cast(extract(isodow from ts) - 1 as int) as weekday, cast(extract(day from ts) as int) as day, cast(extract(month from ts) as int) as month from events")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.minute(t).alias("minute"), F.hour(t).alias("hour"), F.weekday(t).alias("weekday"), F.dayofmonth(t).alias("day"), F.month(t).alias("month"))


@query("""with v as (select vec_id, unnest(embedding) as x from embeddings), s as (select vec_id, avg(x::double) as m, stddev_pop(x::double) as d from v group by 1)
select v.vec_id, round(sum(greatest(-1.5, least(1.5, (x::double - m) / (d + 1e-5)))), 5) as clipped, round(max(abs((x::double - m) / (d + 1e-5))), 5) as top from v join s using (vec_id) group by 1""")
def z_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays by their own mean and population deviation, clipped."""
    x = F.col("x")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    d = d.withColumn("m", mean)
    d = d.withColumn("d", F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.size(x)))
    z = F.transform(x, lambda v: (v - F.col("m")) / (F.col("d") + 1e-5))
    total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.greatest(F.lit(-1.5), F.least(F.lit(1.5), v)))
    return rounded(d.select("vec_id", total.alias("clipped"), F.array_max(F.transform(z, lambda v: F.abs(v))).alias("top")), 5)


@query("""with b as (select vec_id, embedding[1] > 0 as lowest, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings)
select vec_id, cast(i // 32 as int) as word, cast(sum(case when x > 0 then 1::bigint << (i % 32) else 0 end) as bigint) as code, any_value(lowest) as lowest from b group by vec_id, i // 32""")
def sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of all components as numbers of 32 bits each, and the first one's lowest bit again."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", scoring.sign_words("embedding", 32).alias("words"))
    lowest = F.element_at(scoring.bits_of(F.element_at("words", 1), 32), 1) == 1
    return d.select("vec_id", lowest.alias("lowest"), F.posexplode("words").alias("word", "code")).select("vec_id", "word", "code", "lowest")


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}_]+')) as term from documents), total as (select count(*) as docs, (select count(*) from w)::double / count(*) as mean from documents),
t as (select doc_id, term, count(*) as tf from w group by 1, 2), d as (select term, count(*) as df from t group by 1), i0 as (select term, ln(docs - df + 0.5) - ln(df + 0.5) as raw from d, total),
i as (select term, case when raw < 0 then 0.25 * (select avg(raw) from i0) else raw end as idf from i0), len as (select doc_id, count(*) as len from w group by 1),
q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}_]+')) as term from benchmark) group by 1, 2),
s as (select query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 8) as score from q join t using (term) join i using (term) join len using (doc_id), total group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from s)
select query_id, doc_id, cast(place as int) as place, round(score, 5) as score, round(score / max(score) over (partition by query_id), 5) as share from r where place <= 10""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rounded(retrieval.bm25(table(spark, sf_dir, "documents"), asked), 5)
