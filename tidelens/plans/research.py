"""Registered queries that join over time, measure factors, and test portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import ranks
from tidelens.functions import windows as w_
from tidelens.operators import bootstrap, joins, portfolio, stats
from tidelens.plans.cross_section import ALPHA, FACTORS, alphas, factors
from tidelens.plans.panels import FQ, PD, PM, daily, monthly, pct_sql, quarterly, rank_sql, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {PM}, t as (select *, close / lag(close, 3) over w - 1 as f, lead(close) over w / close - 1 as y from pm window w as (partition by ticker order by date)),
u as (select * from t where f is not null and y is not null), v as (select date, {rank_sql('f', 'date')} as a, {rank_sql('y', 'date')} as b from u)
select date, round(case when not isnan(corr(a, b)) then corr(a, b) end, 6) as ic, count(*) as n from v group by 1 having count(*) >= 5""")
def rank_ic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three months' momentum against the next month's return."""
    d = monthly(spark, sf_dir).select("ticker", "date", w_.momentum("close", w_.series(), 3).alias("f"), w_.forward("close", w_.series()).alias("y"))
    return rounded(stats.rank_ic(d, "f", "y"))


LONG = f"""{FACTORS}, lg as (select date, sector, f, x, y from (select date, sector, y, unnest(['mom', 'long', 'vol', 'value', 'turn']) as f, unnest([mom, long, vol, value, turn]) as x from fa) where x is not null and y is not null),
rr as (select *, {rank_sql('x', 'f', 'date')} as a, {rank_sql('y', 'f', 'date')} as b from lg),
ics as (select f as factor, date, round(case when not isnan(corr(a, b)) then corr(a, b) end, 9) as ic, count(*) as n from rr group by 1, 2 having count(*) >= 10)"""
NAMES = ("mom", "long", "vol", "value", "turn")


def _ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor, date, ic, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in NAMES])).alias("p")
    d = factors(spark, sf_dir).select("date", "y", pairs).select("date", "p.factor", "p.x", "y").filter("x is not null and y is not null")
    d = d.select("date", "factor", ranks.avg_rank("x", "factor", "date").alias("a"), ranks.avg_rank("y", "factor", "date").alias("b"))
    return d.groupBy("factor", "date").agg(F.round(w_.corr("a", "b"), 9).alias("ic"), F.count("*").alias("n")).filter("n >= 10")


@query(f"""with {LONG} select factor, round(avg(ic), 6) as mean, round(stddev_pop(ic), 6) as deviation, round(avg(ic) / (stddev_pop(ic) + 1e-6), 6) as ir,
  round(avg(case when ic > 0 then 1.0 else 0.0 end), 6) as positive, round(avg(ic) / (stddev_pop(ic) / sqrt(count(*))), 6) as t, count(*) as n from ics group by 1""")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.ic_summary(_ics(spark, sf_dir), ["factor"]))


REGIME = "rg as (select date, case when m > 0.03 then 'bull' when m < -0.03 then 'bear' else 'flat' end as regime from (select date, round(avg(r), 9) as m from pr where r is not null group by 1))"


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and regime by the panel's mean return, beyond 3 % either way."""
    m = monthly(spark, sf_dir).withColumn("r", w_.momentum("close", w_.series(), 1)).filter("r is not null").groupBy("date").agg(F.round(F.avg("r"), 9).alias("m"))
    return m.select("date", F.when(F.col("m") > 0.03, "bull").when(F.col("m") < -0.03, "bear").otherwise("flat").alias("regime"))


@query(f"with {LONG}, {REGIME} select factor, regime, round(avg(ic), 6) as mean, count(*) as n from ics join rg using (date) group by 1, 2")
def ic_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ics(spark, sf_dir).join(F.broadcast(regimes(spark, sf_dir)), "date")  # one row a date
    return rounded(found.groupBy("factor", "regime").agg(F.avg("ic").alias("mean"), F.count("*").alias("n")))


def _nw_sql(table: str, group: str) -> str:
    return f"""nw1 as (select *, ic - avg(ic) over (partition by {group}) as e, least(count(*) over (partition by {group}) - 1, 4) as l from {table}),
nw2 as (select *, {", ".join(f"coalesce(e * lag(e, {k}) over (partition by {group} order by date), 0) as c{k}" for k in range(1, 5))} from nw1),
nw as (select {group}, count(*) as n, avg(ic) as mean, sum(e * e {" ".join(f"+ case when {k} <= l then 2 * (1 - {k} / (l + 1)) * c{k} else 0 end" for k in range(1, 5))}) as v from nw2 group by {group})"""


@query(f"""with {FACTORS}, hz as (select ticker, date, mom, unnest([1, 3, 6, 12]) as horizon, unnest([{", ".join(f"lead(close, {h}) over w / close - 1" for h in (1, 3, 6, 12))}]) as y from fa window w as (partition by ticker order by date)),
ok as (select * from hz where mom is not null and y is not null), rr as (select *, {rank_sql('mom', 'horizon', 'date')} as a, {rank_sql('y', 'horizon', 'date')} as b from ok),
ic as (select horizon, date, round(case when not isnan(corr(a, b)) then corr(a, b) end, 9) as ic from rr group by 1, 2 having count(*) >= 10), {_nw_sql('ic', 'horizon')}
select cast(horizon as int) as horizon, n, round(mean, 6) as mean, round(case when n >= 5 then mean / sqrt(v / (n * n)) end, 6) as t from nw""")
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ic and its Newey-West t by horizon."""
    d = factors(spark, sf_dir)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), w_.forward("close", w_.series(), h).alias("y")) for h in (1, 3, 6, 12)])
    d = d.select("date", "mom", ahead.alias("h")).select("date", "mom", F.explode("h").alias("h")).select("date", "mom", "h.horizon", "h.y").filter("mom is not null and y is not null")
    d = d.select("date", "horizon", ranks.avg_rank("mom", "horizon", "date").alias("a"), ranks.avg_rank("y", "horizon", "date").alias("b"))
    ics = d.groupBy("horizon", "date").agg(F.round(w_.corr("a", "b"), 9).alias("ic"), F.count("*").alias("m")).filter("m >= 10")
    return rounded(stats.newey_west(ics, "ic", ["horizon"]))


@query(f"with {LONG}, {_nw_sql('ics', 'factor')} select factor, n, round(mean, 6) as mean, round(case when n >= 5 then mean / sqrt(v / (n * n)) end, 6) as t from nw")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.newey_west(_ics(spark, sf_dir), "ic", ["factor"]))


@query(f"""with {LONG}, s as (select factor, avg(ic) as ic, avg(ic) / (stddev_pop(ic) + 1e-6) as ir from ics group by 1)
select factor, round(0.7 * (abs(ic) - min(abs(ic)) over ()) / (max(abs(ic)) over () - min(abs(ic)) over () + 1e-9) + 0.3 * (abs(ir) - min(abs(ir)) over ()) / (max(abs(ir)) over () - min(abs(ir)) over () + 1e-9), 6) as score from s""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of min-max shares of ic and information ratio. A trained model's importance would weigh .3; without one its share goes to ic."""
    s = stats.ic_summary(_ics(spark, sf_dir), ["factor"]).select("factor", F.abs("mean").alias("a"), F.abs("ir").alias("b"))
    w = Window.partitionBy(F.lit(1))  # one row a factor
    share = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)
    return rounded(s.select("factor", (0.7 * share("a") + 0.3 * share("b")).alias("score")))


@query(f"""with {FACTORS}, g as (select date, mom, ticker, cast(case when p <= 0.2 then 0 when p <= 0.4 then 1 when p <= 0.6 then 2 when p <= 0.8 then 3 else 4 end as double) as g from (select *, {pct_sql('y', 'date')} as p from fa where y is not null and mom is not null)),
r as (select *, row_number() over (partition by date order by mom desc) as p, row_number() over (partition by date order by g desc) as q from g),
d as (select *, avg(case when p <= 10 then 1 / log2(p + 1) else 0 end) over (partition by date, mom) as disc from r)
select date, round(sum(g * disc) / sum(case when q <= 10 then g / log2(q + 1) else 0 end), 6) as ndcg from d group by 1""")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = factors(spark, sf_dir).filter("y is not null and mom is not null").withColumn("g", ranks.relevance(ranks.pct_rank("y", "date")).cast("double"))
    return rounded(stats.ndcg(d, "mom", "g", "date"))


@query(f"""with {FACTORS}, p as (select *, {pct_sql('mom', 'date')} as p from fa where mom is not null and y is not null)
select date, round(avg(case when p > 0.8 then y end) - avg(case when p <= 0.2 then y end), 6) as spread, count(*) as n from p group by 1""")
def quintile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = factors(spark, sf_dir).filter("mom is not null and y is not null").withColumn("g", ranks.relevance(ranks.pct_rank("mom", "date")))
    mean = lambda g: F.avg(F.when(F.col("g") == g, F.col("y")))
    return rounded(d.groupBy("date").agg((mean(4) - mean(0)).alias("spread"), F.count("*").alias("n")))


@query(f"""with {PM}, {FQ}, f as (select ticker, known, revenue, cost, quantity from fq)
select p.ticker, p.date, f.revenue, f.cost, f.quantity, round(f.cost / f.revenue, 6) as margin, round(f.revenue / (p.close * f.quantity), 6) as sales_to_price
from pm p asof left join f on p.ticker = f.ticker and p.date >= f.known""")
def asof_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quarter known on each date, two months after its end."""
    found = joins.asof(monthly(spark, sf_dir).select("ticker", "date", "close"), quarterly(spark, sf_dir), ["ticker"], "date", "known", ["revenue", "cost", "quantity"])
    return found.select("ticker", "date", "revenue", "cost", "quantity", F.round(w_.ratio("cost", "revenue"), 6).alias("margin"), F.round(w_.ratio("revenue", F.col("close") * F.col("quantity")), 6).alias("sales_to_price"))


@query(f"with {FQ} select ticker, quarter, known, round(revenue / lag(revenue, 4) over w - 1, 6) as revenue_yoy, round(quantity / lag(quantity, 4) over w - 1, 6) as quantity_yoy from fq window w as (partition by ticker order by quarter)")
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = w_.series("ticker", "quarter")
    return rounded(quarterly(spark, sf_dir).select("ticker", "quarter", "known", w_.change("revenue", w, 4).alias("revenue_yoy"), w_.change("quantity", w, 4).alias("quantity_yoy")))


SCORED = f"{ALPHA}, sp as (select ticker, date, close, sector, round(alpha, 6) as score from al)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alphas(spark, sf_dir).select("ticker", "date", "close", "sector", F.round("alpha", 6).alias("score"))


def monthly_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the monthly panel, without the panel: one row a date."""
    return table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "MM").alias("date")).distinct()


CRASH = f"""{SCORED}, dt as (select date, lead(date) over (order by date) as next_date from (select distinct date from sp)),
hd as (select *, row_number() over (partition by date order by score desc nulls last, ticker) as k, count(*) over (partition by date) as n from sp),
rt as (select h.ticker, h.date, d.next_date, coalesce(p.close / h.close - 1, -1.0) as ret from hd h join dt d using (date) left join sp p on p.ticker = h.ticker and p.date = d.next_date
  where h.k <= greatest(1, floor(h.n * 0.2)) and d.next_date is not null)"""


def crash_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel is computed once: dates are few and come from the prices alone, and each row knows its ticker's next row."""
    w = Window.partitionBy("date")
    d = scored(spark, sf_dir).withColumns({"next_row": F.lead("date").over(w_.series()), "next_close": F.lead("close").over(w_.series())})
    k, n = F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "ticker")), F.count("*").over(w)
    held = d.select("ticker", "date", "close", "next_row", "next_close", k.alias("k"), n.alias("n")).filter(F.col("k") <= ranks.top_count(F.col("n"), 0.2))
    return portfolio.held_to_next(held, portfolio.rebalance_dates(monthly_dates(spark, sf_dir)))


@query(f"with {CRASH} select ticker, date, next_date, round(ret, 6) as ret from rt")
def survivor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crash_returns(spark, sf_dir).select("ticker", "date", "next_date", "ret"))


@query(f"""with {CRASH}, m as (select next_date as date, round(avg(ret), 9) as ret from rt group by 1), n as (select *, product(1 + ret) over (order by date) as nav from m)
select date, round(ret, 6) as ret, round(nav, 8) as nav, round(case when max(nav) over (order by date) > 0 then nav / max(nav) over (order by date) - 1 end, 6) as drawdown from n""")
def crash_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifth by composite score, held until the next date; what goes missing is a total loss."""
    m = crash_returns(spark, sf_dir).groupBy(F.col("next_date").alias("date")).agg(F.round(F.avg("ret"), 9).alias("ret"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a date
    m = m.withColumn("nav", w_.nav("ret", w))
    return m.select("date", F.round("ret", 6).alias("ret"), F.round("nav", 8).alias("nav"), F.round(w_.drawdown("nav", w), 6).alias("drawdown"))


@query(f"""with {SCORED}, dt as (select date, row_number() over (order by date) - 1 as turn from (select distinct date from sp)),
hd as (select *, row_number() over (partition by date order by score desc nulls last, ticker) as k, count(*) over (partition by date) as n from sp),
mb as (select turn, ticker from hd join dt using (date) where k <= greatest(1, floor(n * 0.3))),
sz as (select turn, count(*) as n from mb group by 1), sm as (select a.turn, count(*) as same from mb a join mb b on a.ticker = b.ticker and b.turn = a.turn - 1 group by 1)
select s.turn, round(coalesce(same, 0) / s.n, 6) as kept, round(1 - coalesce(same, 0) / s.n, 6) as turnover from sz s join sz b on b.turn = s.turn - 1 left join sm on sm.turn = s.turn where s.n > 5 and b.n > 5""")
def turnover_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    w = Window.partitionBy("date")
    held = d.select("ticker", "date", F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "ticker")).alias("k"), F.count("*").over(w).alias("n")).filter(F.col("k") <= ranks.top_count(F.col("n"), 0.3))
    turns = portfolio.rebalance_dates(monthly_dates(spark, sf_dir)).select("date", F.col("turn").cast("long").alias("turn"))
    return rounded(portfolio.overlap(held.join(F.broadcast(turns), "date").select("ticker", "turn"), 5))


@query(f"""with {PD}, k as (select *, row_number() over (partition by ticker order by date) as k from pd), e as (select distinct ticker, cast(date_trunc('month', date) as date) as date from pd)
, f as (select e.ticker, e.date, min(k.k) as k from e join k on k.ticker = e.ticker and k.date > e.date group by 1, 2)
select e.ticker, e.date, a.date as entry_date, b.date as exit_date, round(b.close / a.close - 1, 6) as ret from e left join f using (ticker, date) left join k a on a.ticker = e.ticker and a.k = f.k left join k b on b.ticker = e.ticker and b.k = f.k + 10""")
def hold_n_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bought on the first row after each month's first day, sold ten rows on."""
    d = daily(spark, sf_dir)
    events = d.select("ticker", F.trunc("date", "MM").alias("date")).distinct()
    found = joins.nth_row_after(events, d, 10)
    return found.select("ticker", "date", "entry_date", "exit_date", F.round(w_.ratio("exit", "entry") - 1, 6).alias("ret"))


@query(f"""with {ALPHA}, k as (select *, row_number() over (partition by date order by round(alpha, 6) desc nulls last, ticker) as k from al where y is not null),
m as (select date, round(avg(case when k <= 20 then y end), 10) as p, round(avg(y), 10) as b from k group by 1),
n as (select date, product(1 + p) over w as portfolio, product(1 + b) over w as benchmark from m window w as (order by date))
select date, round(portfolio, 6) as portfolio, round(benchmark, 6) as benchmark, round(portfolio / max(portfolio) over (order by date) - 1, 6) as drawdown from n""")
def topk_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = alphas(spark, sf_dir).filter("y is not null")
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(F.round("alpha", 6)), "ticker"))
    m = d.withColumn("k", k).groupBy("date").agg(F.round(F.avg(F.when(F.col("k") <= 20, F.col("y"))), 10).alias("p"), F.round(F.avg("y"), 10).alias("b"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a date
    m = m.select("date", w_.nav("p", w).alias("portfolio"), w_.nav("b", w).alias("benchmark"))
    return rounded(m.withColumn("drawdown", w_.drawdown("portfolio", w)))


# Signals of each month: z is momentum over its deviation within the date.
SIGNALS = f"""{FACTORS}, z0 as (select *, (mom - avg(mom) over d) / stddev_samp(mom) over d as z0 from fa where mom is not null and y is not null window d as (partition by date)),
sg as (select ticker, date, sector, vol, size, y, round(z0, 9) as z, case when z0 > 0 then 'BUY' when z0 < 0 then 'SELL' else 'HOLD' end as direction from z0 where z0 is not null)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("date")
    d = factors(spark, sf_dir).filter("mom is not null and y is not null")
    d = d.withColumn("z", w_.ratio(F.col("mom") - F.avg("mom").over(w), F.stddev_samp("mom").over(w))).filter("z is not null")
    return d.select("ticker", "date", "sector", "vol", "size", "y", F.round("z", 9).alias("z"), F.when(F.col("z") > 0, "BUY").when(F.col("z") < 0, "SELL").otherwise("HOLD").alias("direction"))


ABC = f"""{SIGNALS}, kk as (select *, row_number() over (partition by date order by z desc, ticker) as k, row_number() over (partition by date order by z, ticker desc) as kr, count(*) over (partition by date) as n from sg),
sd as (select date, y, unnest(['A', 'B', 'C']) as label, unnest([case direction when 'BUY' then 1 when 'SELL' then -1 else 0 end, case when abs(z) > 1.5 then case direction when 'BUY' then 1 else -1 end else 0 end,
  case when k <= greatest(1, floor(n * 0.3)) then 1 when kr <= greatest(1, floor(n * 0.3)) then -1 else 0 end]) as side from kk),
ls as (select label, date, round(avg(case when side = 1 then y end) - avg(case when side = -1 then y end), 9) as spread from sd group by 1, 2)"""


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, date and spread of the portfolios of all signals, of strong ones, and of the top and bottom 30 %."""
    w = Window.partitionBy("date")
    s = signals(spark, sf_dir)
    s = s.select("*", F.row_number().over(w.orderBy(F.desc("z"), "ticker")).alias("k"), F.row_number().over(w.orderBy("z", F.desc("ticker"))).alias("kr"), F.count("*").over(w).alias("n"))
    whole = F.when(F.col("direction") == "BUY", 1).when(F.col("direction") == "SELL", -1).otherwise(0)
    end = ranks.top_count(F.col("n"), 0.3)
    sides = {"A": whole, "B": F.when(F.abs("z") > 1.5, whole).otherwise(0), "C": F.when(F.col("k") <= end, 1).when(F.col("kr") <= end, -1).otherwise(0)}
    s = s.select("date", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("side")) for k, v in sides.items()])).alias("p")).select("date", "y", "p.label", "p.side")
    return portfolio.long_short(s, F.col("side"), "y", ["label", "date"]).select("label", "date", F.round("spread", 9).alias("spread"))


@query(f"""with {ABC}, s as (select * from ls where spread is not null), c as (select *, product(1 + spread) over (partition by label order by date) as nav from s),
f as (select *, greatest(1, max(nav) over (partition by label order by date)) as top from c)
select label, count(*) as n, round(avg(spread), 6) as mean, round(avg(case when spread > 0 then 1.0 else 0.0 end), 6) as win_rate, round(stddev_samp(spread), 6) as deviation,
  round(avg(spread) / stddev_samp(spread) * sqrt(12), 6) as sharpe, round(avg(spread) / (stddev_samp(spread) / sqrt(count(*))), 6) as t_stat,
  round(greatest(0, max((top - nav) / top)), 6) as max_drawdown, cast(count_if(spread > 0) as bigint) as n_up, cast(count(*) - count_if(spread > 0) as bigint) as n_down from f group by 1""")
def portfolio_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.full_stats(spreads(spark, sf_dir), "spread", ["label"]).drop("nav"))


@query(f"""with {ABC}, {REGIME} select label, regime, count(*) as n, round(avg(spread), 6) as mean from ls join rg using (date) where spread is not null group by 1, 2""")
def portfolio_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spreads(spark, sf_dir).filter("spread is not null").join(F.broadcast(regimes(spark, sf_dir)), "date")
    return rounded(s.groupBy("label", "regime").agg(F.count("*").alias("n"), F.avg("spread").alias("mean")))


@query(f"""with {SIGNALS}, l as (select * from sg where date = (select max(date) from sg)), k as (select *, row_number() over (order by z desc, ticker) as a, row_number() over (order by z, ticker desc) as b from l)
select cast(m as int) as k, round(avg(case when a <= m then y end) - avg(case when b <= m then y end), 6) as equal,
  round(sum(case when a <= m then y * abs(z) end) / sum(case when a <= m then abs(z) end) - sum(case when b <= m then y * abs(z) end) / sum(case when b <= m then abs(z) end), 6) as weighted
from k, (values (3), (5), (10), (20)) v(m) group by 1""")
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the k best over the k worst of the last date, with equal weights and by score."""
    s = signals(spark, sf_dir)
    s = s.join(F.broadcast(s.agg(F.max("date").alias("date"))), "date")
    one = Window.partitionBy(F.lit(1))  # the tickers of one date
    s = s.select("y", F.abs("z").alias("w"), F.row_number().over(one.orderBy(F.desc("z"), "ticker")).alias("a"), F.row_number().over(one.orderBy("z", F.desc("ticker"))).alias("b"))
    s = s.select("*", F.explode(F.array(*[F.lit(k) for k in (3, 5, 10, 20)])).alias("k"))  # after the ranks, or they would count each size
    mean = lambda c: F.avg(F.when(F.col(c) <= F.col("k"), F.col("y")))
    heavy = lambda c: F.sum(F.when(F.col(c) <= F.col("k"), F.col("y") * F.col("w"))) / F.sum(F.when(F.col(c) <= F.col("k"), F.col("w")))
    return rounded(s.groupBy("k").agg((mean("a") - mean("b")).alias("equal"), (heavy("a") - heavy("b")).alias("weighted")))


@query(f"""with {SIGNALS}, o as (select *, round(100 * {pct_sql('size', 'date')}, 4) as o from sg),
p as (select unnest(['full', 'signal', 'factor', 'random']) as part, unnest([case direction when 'BUY' then 1 else -1 end, case direction when 'BUY' then 1 else -1 end, case when o > 70 then 1 when o <= 30 then -1 else 0 end, case when ticker % 2 = 0 then 1 else -1 end]) as side,
  unnest([o, 1.0, 1.0, 1.0]) as w, y from o)
select part, round(sum(case when side = 1 then w * y end) / sum(case when side = 1 then w end) - sum(case when side = -1 then w * y end) / sum(case when side = -1 then w end), 6) as spread from p group by 1""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of signals weighed by score, of signals, of scores alone, and of a split that knows nothing."""
    s = signals(spark, sf_dir).withColumn("o", F.round(100 * ranks.pct_rank("size", "date"), 4))
    way = F.when(F.col("direction") == "BUY", 1).otherwise(-1)
    kinds = {"full": (way, F.col("o")), "signal": (way, F.lit(1.0)), "factor": (F.when(F.col("o") > 70, 1).when(F.col("o") <= 30, -1).otherwise(0), F.lit(1.0)), "random": (F.when(F.col("ticker") % 2 == 0, 1).otherwise(-1), F.lit(1.0))}
    s = s.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), a.alias("side"), b.alias("w")) for k, (a, b) in kinds.items()])).alias("p")).select("y", "p.*")
    mean = lambda side: F.sum(F.when(F.col("side") == side, F.col("w") * F.col("y"))) / F.sum(F.when(F.col("side") == side, F.col("w")))
    return rounded(s.groupBy("part").agg((mean(1) - mean(-1)).alias("spread")))


@query()
def bootstrap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 resamples. Rows only: SQL elsewhere doesn't have the generator that draws them."""
    s = signals(spark, sf_dir).select(F.concat_ws("/", "ticker", "date").alias("id"), F.when(F.col("direction") == "BUY", 1).otherwise(-1).alias("side"), "y")
    return rounded(bootstrap.interval(bootstrap.spreads(s, "side", "y", "id", 500)))


@query(f"""with {FACTORS}, m as (select *, median(mom) over (partition by date) as m from fa), d as (select *, median(abs(mom - m)) over (partition by date) as d from m),
r as (select sector, date, {pct_sql('mom', 'date', 'sector')} as p, size from d)
select sector, round(avg(p), 6) as mean, round(stddev_samp(p), 6) as deviation, round(case when not isnan(corr(p, size)) then corr(p, size) end, 6) as with_size, count(p) as n from r group by 1""")
def neutralisation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within sectors should have alike means and little to do with size."""
    d = factors(spark, sf_dir).select("sector", "size", ranks.pct_rank("mom", "date", "sector").alias("p"))
    return rounded(d.groupBy("sector").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("deviation"), w_.corr("p", "size").alias("with_size"), F.count("p").alias("n")))


@query(f"""with {SIGNALS}, a as (select date, list_sort(list(z)) as s, count(*) as n, avg(z) as mean from sg group by 1)
select date, n, round(mean, 6) as mean, {", ".join(f"round(s[cast(floor(n * {p}) as int) + 1], 6) as p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))} from a""")
def empirical_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By index int(n p) of the sorted values of a date, not interpolated. A date's values are ranked by a window, which spills, and never gathered in a list."""
    w = Window.partitionBy("date")
    s = signals(spark, sf_dir).select("date", "z", F.row_number().over(w.orderBy("z")).alias("k"), F.count("z").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.floor(F.col("n") * F.lit(p)).cast("int") + 1, F.col("z")))
    return rounded(s.groupBy("date", "n").agg(F.avg("z").alias("mean"), *[at(p).alias(f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))


@query(f"""with {SIGNALS}, e as (select *, case when vol is null then 'no history' end as error from sg)
select date, count(*) as n, cast(count_if(direction in ('BUY', 'SELL') and z is not null and error is null) as bigint) as valid, cast(count_if(error is not null) as bigint) as errors from e group by 1""")
def valid_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that may be traded: to buy or to sell, with a z and without an error (here: too short a history for a volatility)."""
    d = signals(spark, sf_dir).withColumn("error", F.when(F.col("vol").isNull(), "no history"))
    return d.groupBy("date").agg(F.count("*").alias("n"), F.count_if(portfolio.valid()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query(f"""with {FACTORS}, m as (select sector, date, avg(y) as r from fa where y is not null group by 1, 2), c as (select *, exp(sum(ln(1 + r)) over (partition by sector order by date)) as nav from m),
d as (select sector, nav / lag(nav) over (partition by sector order by date) - 1 as c from c)
select sector, count(c) as n, round(sqrt(12) * avg(c) / stddev_samp(c), 6) as sharpe from d group by 1""")
def nav_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of each sector's equally weighted portfolio, from the changes of its compounded value."""
    m = factors(spark, sf_dir).filter("y is not null").groupBy("sector", "date").agg(F.avg("y").alias("r"))
    return rounded(portfolio.nav_sharpe(m, "r", ["sector"]))
