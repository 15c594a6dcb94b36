"""Registered queries of portfolios over several holding periods, quantile curves, sized positions, and indicator lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import ranks, scoring
from tidelens.functions import windows as w_
from tidelens.operators import ensemble as en
from tidelens.operators import joins, panel, portfolio, scan
from tidelens.plans.cross_section import FACTORS, factors
from tidelens.plans.panels import MONTHS, PD, daily, months, pct_sql, rounded, table
from tidelens.plans.research import SIGNALS, attribution, signals
from tidelens.plans.research import SQL as RESEARCH_SQL
from tidelens.plans.signal_rules import ANALYST_WEIGHTS, REPORTS, SCORES, figures, reports, scores
from tidelens.plans.time_series import INDEX, _index

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rows that positions are held for. Fixed values.
HOLDS = (10, 20, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HELD = f"""{PD}, r as (select *, close / lag(close) over (partition by ticker order by date) - 1 as r from pd),
s as (select ticker, date, date_trunc('month', date)::date as month, round(close / lag(close, 20) over w - 1, 9) as m, {", ".join(f"round(lead(close, {h}) over w / close - 1, 9) as f{h}" for h in HOLDS)},
  round(coalesce(case when count(r) over v >= 2 then stddev_samp(r) over v end, 0), 9) as vol, row_number() over (partition by ticker, date_trunc('month', date) order by date desc) as k
  from r window w as (partition by ticker order by date), v as (partition by ticker order by date rows 59 preceding)),
l as (select * from s where k = 1 and m is not null), g as (select *, (m - avg(m) over d) / nullif(stddev_samp(m) over d, 0) as z0, row_number() over (partition by month order by vol, ticker) as kv, count(*) over d as nv from l window d as (partition by month)),
z as (select *, round(z0, 9) as z, max(case when kv = cast(floor(nv * 0.9) as int) + 1 then vol end) over (partition by month) as edge from g where z0 is not null),
k as (select *, row_number() over (partition by month order by z desc, ticker) as a, row_number() over (partition by month order by z, ticker desc) as b, count(*) over (partition by month) as n from z),
p as (select ticker, month, vol < edge as calm, f10, f20, f30, unnest(['A', 'B', 'C']) as label, unnest([case when z > 0 then 1 when z < 0 then -1 else 0 end, case when abs(z) > 1.5 then case when z > 0 then 1 else -1 end else 0 end,
  case when a <= greatest(1, floor(n * 0.3)) then 1 when b <= greatest(1, floor(n * 0.3)) then -1 else 0 end]) as side from k),
h as (select label, month, calm, side, unnest([{", ".join(map(str, HOLDS))}]) as hold, unnest([f10, f20, f30]) as ret from p),
q as (select label, hold, month, filtered, count(case when side = 1 then ret end) as n_long, count(case when side = -1 then ret end) as n_short, round(avg(case when side = 1 then ret end) - avg(case when side = -1 then ret end), 9) as spread
  from h, (values (false), (true)) v(filtered) where calm or not filtered group by 1, 2, 3, 4)"""


def held_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, hold, month, filtered, n_long, n_short and spread: three portfolios of each month's last rows, held for 10, 20 and 30 rows, with and without the tenth of highest volatility."""
    w, month = w_.series(), Window.partitionBy("month")
    d = daily(spark, sf_dir).withColumn("r", w_.momentum("close", w, 1))
    d = d.select(
        "ticker", "date", F.trunc("date", "MM").alias("month"), F.round(w_.momentum("close", w, 20), 9).alias("m"), F.round(w_.trailing_volatility("r", w, 60), 9).alias("vol"),
        *[F.round(w_.forward("close", w, h), 9).alias(f"f{h}") for h in HOLDS],
    )
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "month").orderBy(F.desc("date")))).filter("k = 1 and m is not null")
    d = d.withColumns({"z": F.round(w_.ratio(F.col("m") - F.avg("m").over(month), F.stddev_samp("m").over(month)), 9), "kv": F.row_number().over(month.orderBy("vol", "ticker")), "nv": F.count("*").over(month)})
    d = d.filter("z is not null")
    d = d.withColumns({
        "calm": F.col("vol") < F.max(F.when(F.col("kv") == F.floor(F.col("nv") * 0.9) + 1, F.col("vol"))).over(month),
        "a": F.row_number().over(month.orderBy(F.desc("z"), "ticker")), "b": F.row_number().over(month.orderBy("z", F.desc("ticker"))), "n": F.count("*").over(month),
    })
    end = ranks.top_count(F.col("n"), 0.3)
    way = F.signum("z").cast("int")
    sides = {"A": way, "B": F.when(F.abs("z") > 1.5, way).otherwise(0), "C": F.when(F.col("a") <= end, 1).when(F.col("b") <= end, -1).otherwise(0)}
    each = [F.struct(F.lit(k).alias("label"), v.alias("side"), F.lit(h).alias("hold"), F.col(f"f{h}").alias("ret")) for k, v in sides.items() for h in HOLDS]
    d = d.select("month", "calm", F.explode(F.array(*each)).alias("p")).select("month", "calm", "p.*")
    d = d.withColumn("filtered", F.explode(F.array(F.lit(False), F.lit(True)))).filter("calm or not filtered")
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("ret")))
    count = lambda s: F.count(F.when(F.col("side") == s, F.col("ret")))
    return d.groupBy("label", "hold", "month", "filtered").agg(count(1).alias("n_long"), count(-1).alias("n_short"), F.round(mean(1) - mean(-1), 9).alias("spread"))


@query(f"with {_HELD} select label, cast(hold as int) as hold, month, filtered, n_long, n_short, round(spread, 6) as spread from q")
def portfolio_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(held_spreads(spark, sf_dir))


@query(f"""with {_HELD}, known as (select * from q where spread is not null)
select label, cast(hold as int) as hold, filtered, count(*) as n, round(avg(spread), 6) as mean, round(avg(case when spread > 0 then 1.0 else 0.0 end), 6) as win_rate, round(coalesce(stddev_samp(spread), 0), 6) as deviation,
  round(case when stddev_samp(spread) > 1e-9 then avg(spread) / (stddev_samp(spread) / sqrt(count(*))) end, 6) as t_stat from known group by 1, 2, 3""")
def holds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by portfolio, holding period and filter."""
    found = portfolio.full_stats(held_spreads(spark, sf_dir), "spread", ["label", "hold", "filtered"], "month")
    return rounded(found.select("label", "hold", "filtered", "n", "mean", "win_rate", "deviation", "t_stat"))


@query(f"""with {FACTORS}, v as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by mom desc, ticker) as k from fa where mom is not null and y is not null),
e as (select date, quantile_cont(mom, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from v where n >= 10 group by 1),
b as (select v.*, greatest((select count(distinct x) from unnest(e.e) t(x) where x < mom) - 1, 0) as b from v join e using (date)),
m as (select 'q' || (b + 1) as series, date, round(avg(y), 10) as ret from b group by 1, 2 union all select 'top', date, round(avg(case when k <= 30 then y end), 10) from b group by 2 union all select 'all', date, round(avg(y), 10) from b group by 2)
select series, date, round(ret, 6) as ret, round(product(1 + ret) over (partition by series order by date), 5) as nav from m""")
def quintile_navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and curves of the fifths by score, of the 30 best and of all, on dates with ten tickers at least."""
    w = Window.partitionBy("date")
    d = factors(spark, sf_dir).filter("mom is not null and y is not null").withColumn("n", F.count("*").over(w)).filter("n >= 10")
    d = d.withColumns({"k": F.row_number().over(w.orderBy(F.desc("mom"), "ticker")), "e": ranks.qcut_edges("mom", 5, "date")})
    own = F.concat(F.lit("q"), (ranks.bin_of("mom", "e") + 1).cast("string"))
    d = d.select("date", "y", F.explode(F.array_compact(F.array(own, F.when(F.col("k") <= 30, "top"), F.lit("all")))).alias("series"))
    m = d.groupBy("series", "date").agg(F.round(F.avg("y"), 10).alias("ret"))
    return m.select("series", "date", F.round("ret", 6).alias("ret"), F.round(w_.nav("ret", w_.series("series")), 5).alias("nav"))


@query(f"""with {SIGNALS}, st as (select s_suppkey as ticker, case when s_suppkey % 11 <> 0 then (s_suppkey % 45) / 10::double end as de, 0.3 + (s_suppkey % 20) / 10::double as cr from supplier),
p as (select s.date, s.direction, round(tanh(abs(z)), 9) as strength, y from sg s join st using (ticker) where not (coalesce(de, 0) > 3 and coalesce(cr, 1) < 0.8)),
r as (select *, round(case direction when 'BUY' then strength * y when 'SELL' then -strength * y else 0 end, 9) as gain from p),
t as (select round(count_if(gain > 0) / nullif(count_if(strength > 0.1), 0), 6) as win_rate from r), m as (select date, count(*) as n, round(avg(gain), 9) as ret from r group by 1)
select date, n, round(ret, 6) as ret, round(product(1 + ret) over (order by date), 6) as nav, win_rate from m, t""")
def strength_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's gain by its strength, without the busts; the share of gains is over the signals with a strength above a tenth, as published."""
    s = signals(spark, sf_dir).join(figures(spark, sf_dir).select("ticker", "de", "cr"), "ticker").filter(~scoring.is_bust("de", "cr"))
    s = s.select("date", F.round(F.tanh(F.abs("z")), 9).alias("strength"), "direction", "y")
    found = portfolio.strength_gains(s, "direction", "strength", "y", digits=9)
    return found.select("date", "n", F.round("ret", 6).alias("ret"), F.round("nav", 6).alias("nav"), F.round("win_rate", 6).alias("win_rate"))


_ROUNDED = ("value_score", "quality_score", "momentum_score", "size_score", "volatility_score")
_O = f"""{SCORES}, r2 as (select *, {", ".join(f"round_even({c}, 2) as r_{c}" for c in _ROUNDED)} from so),
os as (select *, round_even(0.25 * r_value_score + 0.35 * r_quality_score + 0.2 * r_momentum_score + 0.1 * r_size_score + 0.1 * r_volatility_score, 2) as o_score from r2)"""
_SIZED = """case when abs(z) > 2 and doubt < 0.05 then case when z > 0 then 'STRONG_TREND_UP' else 'STRONG_TREND_DOWN' end when doubt > 0.06 then 'HIGH_VOL' else 'RANGING_MIXED' end"""


def _position_sql(given: str, sentiment: str, risk: str) -> str:
    return f"""ps as (select *, {_SIZED} as rg, tanh(abs(z)) * exp(-10 * greatest(0, doubt - 0.03)) as cap0, coalesce(de, 0) > 3 and coalesce(cr, 1) < 0.8 as bust from {given}),
pz as (select *, least(1, greatest(0, least(1, cap0 * case rg when 'HIGH_VOL' then 0.3 when 'RANGING_MIXED' then 0.7 else 1 end * (1 + 0.3 * {sentiment}) * (1 - {risk}))) * (0.5 + o_score / 100)) as sized from ps)"""


def o_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() with the O-score: the five scores rounded to two digits, weighed, and rounded again."""
    return scores(spark, sf_dir).withColumn("o_score", scoring.overall_score(*[F.col(c) for c in ("value_score", "quality_score", "momentum_score", "size_score", "volatility_score")]))


@query(f"""with {_O}, {_position_sql('os', 'sentiment', 'risk')} select ticker, o_score, case when bust then 'FUNDAMENTAL_BUST_OVERRIDE' else rg end as regime, round(case when bust then 0 else sized end, 6) as strength from pz""")
def o_score_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position sizes by the rounded O-score."""
    d, bust = o_scores(spark, sf_dir), scoring.is_bust("de", "cr")
    regime = F.when(bust, "FUNDAMENTAL_BUST_OVERRIDE").otherwise(scoring.signal_regime("z", "doubt"))
    return d.select("ticker", "o_score", regime.alias("regime"), F.round(F.when(bust, 0.0).otherwise(scoring.position("z", "doubt", "sentiment", "risk", "o_score")), 6).alias("strength"))


@query(f"""with {_O}, {REPORTS}, w as (select unnest([{', '.join(repr(a) for a in ANALYST_WEIGHTS)}]) as analyst, unnest([{', '.join(f'{x}::double' for x in ANALYST_WEIGHTS.values())}]) as w),
c as (select ticker, round(sum(w * sentiment) / sum(w), 4) as c_sentiment, round(sum(w * risk) / sum(w), 4) as c_risk from rep join w using (analyst) group by 1),
j as (select o.*, c_sentiment, c_risk from os o left join c using (ticker)), {_position_sql('j', 'c_sentiment', 'c_risk')}
select ticker, case when c_sentiment is null then 'HOLD' when bust then 'CRASH_SELL' when z > 0 then 'BUY' else 'SELL' end as direction, round(case when c_sentiment is null or bust then 0 else sized end, 5) as strength from pz""")
def consensus_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position sizes by the consensus of the reports on a ticker; without any report HOLD and 0."""
    w = spark.createDataFrame(list(ANALYST_WEIGHTS.items()), "analyst string, w double")
    mean = lambda x: F.round(F.sum(F.col("w") * F.col(x)) / F.sum("w"), 4)
    c = reports(spark, sf_dir).join(F.broadcast(w), "analyst").groupBy("ticker").agg(mean("sentiment").alias("c_sentiment"), mean("risk").alias("c_risk"))
    d, bust, none = o_scores(spark, sf_dir).join(c, "ticker", "left"), scoring.is_bust("de", "cr"), F.col("c_sentiment").isNull()
    direction = F.when(none, "HOLD").when(bust, "CRASH_SELL").when(F.col("z") > 0, "BUY").otherwise("SELL")
    sized = scoring.position("z", "doubt", "c_sentiment", "c_risk", "o_score")
    return d.select("ticker", direction.alias("direction"), F.round(F.when(none | bust, 0.0).otherwise(sized), 5).alias("strength"))


@query(f"""with a as ({RESEARCH_SQL['attribution']}), s as (select max(case when part = 'full' then spread end) as f, max(case when part = 'signal' then spread end) as g, max(case when part = 'factor' then spread end) as x, max(case when part = 'random' then spread end) as r from a)
select round(g - r, 6) as signal_delta, round(x - r, 6) as factor_delta, round(f - r, 6) as full_delta, round((f - r) - ((g - r) + (x - r)), 6) as synergy from s""")
def attribution_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What signals, scores and both add to a split that knows nothing, and what both add beyond the sum of each."""
    of = lambda k: F.coalesce(F.max(F.when(F.col("part") == k, F.col("spread"))), F.lit(0.0))
    s = attribution(spark, sf_dir).agg(of("full").alias("f"), of("signal").alias("g"), of("factor").alias("x"), of("random").alias("r"))
    g, x, f = (F.col(c) - F.col("r") for c in ("g", "x", "f"))
    return rounded(s.select(g.alias("signal_delta"), x.alias("factor_delta"), f.alias("full_delta"), (f - (g + x)).alias("synergy")))


# Indicators of the last 30 calendar days, one row an indicator and day.
_CHOSEN = ("close_200_sma", "close_50_sma", "close_10_ema", "boll", "boll_ub", "boll_lb", "macd", "macds", "macdh", "rsi", "atr", "mfi", "vwma", "close")


@query(f"""with recursive {PD}, l as (select *, row_number() over w as k, lag(close) over w as before, (high + low + close) / 3 as price, lag((high + low + close) / 3) over w as price_before from pd window w as (partition by ticker order by date)),
k as (select *, case when before is not null then greatest(close - before, 0) end as up, case when before is not null then -least(close - before, 0) end as down, greatest(high - low, abs(high - before), abs(low - before)) as reach,
  case when price_before is not null then case when price > price_before then price * volume else 0 end end as came, case when price_before is not null then case when price < price_before then price * volume else 0 end end as went from l),
e as (select ticker, date, k, close as ema, close as fast, close as slow, 0.0::double as signal, up, down, reach as atr from k where k = 1
  union all select k.ticker, k.date, k.k, e.ema * (1 - 2.0 / 11) + k.close * (2.0 / 11), e.fast * (1 - 2.0 / 13) + k.close * (2.0 / 13), e.slow * (1 - 2.0 / 27) + k.close * (2.0 / 27),
    e.signal * 0.8 + 0.2 * ((e.fast * (1 - 2.0 / 13) + k.close * (2.0 / 13)) - (e.slow * (1 - 2.0 / 27) + k.close * (2.0 / 27))),
    coalesce(e.up * 13 / 14 + k.up / 14, k.up), coalesce(e.down * 13 / 14 + k.down / 14, k.down), e.atr * 13 / 14 + k.reach / 14 from e join k on k.ticker = e.ticker and k.k = e.k + 1),
v as (select pd.ticker, pd.date, case when count(*) over w200 = 200 then avg(pd.close) over w200 end as a, case when count(*) over w50 = 50 then avg(pd.close) over w50 end as b, e.ema as c,
  avg(pd.close) over w20 as m, stddev_samp(pd.close) over w20 as s, count(*) over w20 as n, e.fast - e.slow as macd, e.signal as macds, e.fast - e.slow - e.signal as macdh,
  case when e.down = 0 then 100 else 100 - 100 / (1 + e.up / e.down) end as rsi, e.atr, case when count(came) over w14 = 14 then 100 * sum(came) over w14 / nullif(sum(came) over w14 + sum(went) over w14, 0) end as mfi,
  case when count(*) over w14 = 14 then sum(pd.close * pd.volume) over w14 / sum(pd.volume) over w14 end as vwma, pd.close
  from k pd join e using (ticker, date) window w200 as (partition by pd.ticker order by pd.date rows 199 preceding), w50 as (partition by pd.ticker order by pd.date rows 49 preceding), w20 as (partition by pd.ticker order by pd.date rows 19 preceding), w14 as (partition by pd.ticker order by pd.date rows 13 preceding)),
i as (select ticker, date, unnest([{", ".join(repr(c) for c in _CHOSEN)}]) as indicator, unnest([a, b, c, case when n = 20 then m end, case when n = 20 then m + 2 * s end, case when n = 20 then m - 2 * s end, macd, macds, macdh, rsi, atr, mfi, vwma, close]) as value from v),
d as (select ticker, unnest(generate_series(max(date)::timestamp - interval 30 day, max(date)::timestamp, interval 1 day))::date as date from pd group by 1),
g as (select ticker, date, unnest([{", ".join(repr(c) for c in _CHOSEN)}]) as indicator from d)
select g.ticker, g.date, g.indicator, round(i.value, 3) as value, case when i.ticker is null then 'N/A' else 'ok' end as status from g left join i on i.ticker = g.ticker and i.date = g.date and i.indicator = g.indicator""")
def indicator_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen indicators of each ticker over the 30 calendar days up to its last row; days without a row are N/A."""
    d, known = scan.indicators(daily(spark, sf_dir))
    found = panel.indicator_rows(d, "ticker", "date", known, _CHOSEN, 30)
    return found.select("ticker", "date", "indicator", F.round("value", 3).alias("value"), "status")


@query("""with s as (select c_custkey as key, s.s as sample, t.t as step, 100 + ((c_custkey * 7 + s.s * 13 + t.t * t.t * 5 + s.s * t.t * 3) % 40 - 20) / 10.0::double as close from customer, generate_series(1, 5) s(s), generate_series(0, 4) t(t)),
o as (select key, sample, min_by(close, step) as a, max_by(close, step) as b, max(close + 1) as high, min(close - 1) as low from s group by 1, 2),
p as (select key, avg(a) as start, avg(b) as stop from o where sample <= 3 group by 1), q as (select key, start, abs((stop / start - 1) / 0.0309) as z from p),
m as (select *, case when abs(z - 0.5) < 0.1 or abs(z - 1.0) < 0.1 or abs(z - 1.5) < 0.1 then 5 else 3 end as most from q)
select key, count(*) as n_samples, round(avg(b / a - 1), 6) as mean_return, round(stddev_pop(b / a - 1), 6) as std_return, round(avg(high), 6) as predicted_max, round(avg(low), 6) as predicted_min,
  round((avg(high) - avg(low)) / any_value(start), 6) as predicted_range from o join m using (key) where sample <= most group by 1""".replace("min_by", "arg_min").replace("max_by", "arg_max"))
def ensemble_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up samples of each customer as one forecast."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sample"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"))
    close = 100 + ((F.col("key") * 7 + F.col("sample") * 13 + F.col("step") * F.col("step") * 5 + F.col("sample") * F.col("step") * 3) % 40 - 20) / 10.0
    c = c.withColumn("close", close)
    return rounded(en.ensemble(c.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1}), ["key"]))


@query(f"""with {PD}, {INDEX}, o as (select date, close as other from pd where ticker = (select min(ticker) from pd)), j as (select ix.date, ix.close, o.other from ix left join o using (date)),
f as (select *, last_value(other ignore nulls) over (order by date rows unbounded preceding) as filled from j)
select date, close, filled as other, round(case when count(close) over w = 200 then avg(close) over w end / close, 6) as ma_200 from f window w as (order by date rows 199 preceding)""")
def macro_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index and another series on the index's dates; where that has none, its last value."""
    d = daily(spark, sf_dir)
    other = d.join(F.broadcast(d.agg(F.min("ticker").alias("ticker"))), "ticker").select("date", F.col("close").alias("other"))
    w = w_.series()
    j = _index(spark, sf_dir).join(other, "date", "left")
    return j.select("date", "close", w_.filled("other", w).alias("other"), F.round(w_.ratio(w_.frame(F.avg, "close", w, 200), "close"), 6).alias("ma_200"))


@query(f"""with {PD}, {INDEX}, e as (select distinct cast(ts as date) - cast(user_id % 4000 as int) as asked from events)
select e.asked, i.date, i.close from e asof left join ix i on e.asked >= i.date""")
def macro_at_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of the index at or before each date that is asked for; NULL before the first."""
    e = table(spark, sf_dir, "events").select(F.date_sub(F.to_date("ts"), (F.col("user_id") % 4000).cast("int")).alias("asked")).distinct()
    return joins.asof_scalar(e, _index(spark, sf_dir).select("date", "close"), "asked", "date", ["date", "close"])


@query(f"""with pm as {MONTHS}, s as (select s_suppkey as ticker, n_name as sector_name from supplier join nation on n_nationkey = s_nationkey),
x as (select date, round(avg(close), 6) as mean, count(*) as n from pm group by 1), g as (select date, 'wide' as regime from x where n >= 50)
select p.ticker, p.date, coalesce(s.sector_name, 'UNKNOWN') as sector_name, g.regime from pm p left join s using (ticker) left join g using (date)""")
def left_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors and regimes beside the panel of all lines; rows without one stay, so the panel isn't joined with suppliers before."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    p = months(spark, sf_dir).select("ticker", "date")
    g = p.groupBy("date").agg(F.count("*").alias("n")).filter("n >= 50").select("date", F.lit("wide").alias("regime"))
    p = joins.with_dimension(p, s.select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("sector_name")), ["ticker"], {"sector_name": "UNKNOWN"})
    return joins.with_dimension(p, g, ["date"])


@query(f"""with {FACTORS}, s as (select ticker, date, {pct_sql('mom', 'date')} as p, vol from fa),
m as (select ticker, avg(p) as ic, avg(vol) as ir, count(p) as importance from s group by 1 having count(p) > 0 and count(vol) > 0)
select ticker, round(0.4 * (abs(ic) - min(abs(ic)) over ()) / (max(abs(ic)) over () - min(abs(ic)) over () + 1e-9) + 0.3 * (abs(ir) - min(abs(ir)) over ()) / (max(abs(ir)) over () - min(abs(ir)) over () + 1e-9)
  + 0.3 * (importance - min(importance) over ()) / (max(importance) over () - min(importance) over () + 1e-9), 5) as score from m""")
def leaderboard_with_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite with an importance column: here made-up figures of each ticker stand for a factor's."""
    s = factors(spark, sf_dir).select("ticker", ranks.pct_rank("mom", "date").alias("p"), "vol")
    m = s.groupBy("ticker").agg(F.avg("p").alias("ic"), F.avg("vol").alias("ir"), F.count("p").alias("importance"), F.count("vol").alias("n")).filter("importance > 0 and n > 0")
    return panel.leaderboard(m, "ticker", {"ic": 0.4, "ir": 0.3, "importance": 0.3}).withColumn("score", F.round("score", 5))
