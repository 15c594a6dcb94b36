"""Registered queries within one date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import ranks
from tidelens.functions import windows as w_
from tidelens.operators import panel, quantiles
from tidelens.plans.panels import PM, monthly, pct_sql, rank_sql, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Weights of the factors by group of the index; other groups weigh all alike. Fixed values.
WEIGHTS = {
    "large": {"value_rank": 1.0, "mom_rank": -0.5, "long_rank": 0.2, "vol_rank": -0.15, "turn_rank": 0.5},
    "middle": {"value_rank": 1.0, "mom_rank": -0.35, "long_rank": 0.4, "vol_rank": -0.9, "turn_rank": 0.5},
}
DEFAULT_WEIGHT = 0.6
#: Up to this many rows of holding, the large group ignores these. Fixed values.
SHORT_TERM_ROWS, SHORT_TERM_OFF = 20, ("vol_rank",)


def weights(group: str, horizon: int = 20) -> dict[str, float]:
    found = WEIGHTS.get(group, {f: DEFAULT_WEIGHT for f in WEIGHTS["large"]})
    return {f: 0.0 if group == "large" and horizon <= SHORT_TERM_ROWS and f in SHORT_TERM_OFF else x for f, x in found.items()}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pm with mom (3 months), long (12-1), vol (6 months), value (cost over close), turn, size (log of value traded) and y: the next month's return."""
    d = monthly(spark, sf_dir).withColumn("r", w_.momentum("close", w_.series(), 1))
    d = d.select(
        "ticker", "date", "close", "volume", "sector",
        F.round(w_.momentum("close", w_.series(), 3), 8).alias("mom"),
        F.round(w_.momentum("close", w_.series(), 12, skip=1), 8).alias("long"),
        F.round(w_.frame(F.stddev_samp, "r", w_.series(), 6), 8).alias("vol"),
        F.round(w_.ratio("cost", "close"), 6).alias("value"),
        F.round(w_.frame(F.avg, "volume", w_.series(), 3), 6).alias("turn"),
        F.round(F.ln(F.col("close") * F.col("volume") + 1e-6), 6).alias("size"),
        F.round(w_.forward("close", w_.series()), 8).alias("y"),
    )
    return d


FACTORS = f"""{PM}, pr as (select *, close / lag(close) over (partition by ticker order by date) - 1 as r from pm),
fa as (select ticker, date, close, volume, sector, round(close / lag(close, 3) over w - 1, 8) as mom, round(lag(close) over w / lag(close, 12) over w - 1, 8) as long,
  round(case when count(r) over w6 = 6 then stddev_samp(r) over w6 end, 8) as vol, round(cost / close, 6) as value,
  round(case when count(volume) over w3 = 3 then avg(volume) over w3 end, 6) as turn, round(ln(close * volume + 1e-6), 6) as size, round(lead(close) over w / close - 1, 8) as y
  from pr window w as (partition by ticker order by date), w3 as (partition by ticker order by date rows 2 preceding), w6 as (partition by ticker order by date rows 5 preceding))"""


@query(f"with {FACTORS} select ticker, date, {rank_sql('mom', 'date')} as mom_place, round({pct_sql('mom', 'date')}, 6) as mom_rank, round({pct_sql('volume', 'date')}, 6) as volume_rank from fa")
def pct_rank_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = factors(spark, sf_dir)
    return rounded(d.select("ticker", "date", ranks.avg_rank("mom", "date").alias("mom_place"), ranks.pct_rank("mom", "date").alias("mom_rank"), ranks.pct_rank("volume", "date").alias("volume_rank")))


@query(f"""with {FACTORS} select ticker, date, round(coalesce({pct_sql('mom', 'date', 'sector')}, 0.5), 6) as mom_rank,
  floor((2 * (yy * count(yy) over d - sum(yy) over d) + 100 * count(yy) over d) / (200 * count(yy) over d)) / 1e6 as excess
from (select *, cast(round(y * 1e8) as bigint) as yy from fa) window d as (partition by date)""")
def pct_rank_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank within date and sector, NULL as 0.5, and the return over the date's mean, exactly: a mean of 8-digit numbers may end in a tie at the seventh digit."""
    d = factors(spark, sf_dir)
    return rounded(d.select("ticker", "date", F.coalesce(ranks.pct_rank("mom", "date", "sector"), F.lit(0.5)).alias("mom_rank"), ranks.demean_exact("y", "date").alias("excess")))


@query(f"""with {FACTORS}, m as (select *, median(mom) over (partition by date) as m from fa), d as (select *, median(abs(mom - m)) over (partition by date) as d from m)
select ticker, date, round(case when mom is not null then greatest(least(mom, m + 3 * 1.4826 * d), m - 3 * 1.4826 * d) end, 6) as mom, round(coalesce(vol, median(vol) over (partition by date), 0), 9) as vol from d""")
def winsorise_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped by median absolute deviation; NULL as the date's median, then 0."""
    d = panel.winsorise_mad(factors(spark, sf_dir), "mom", ["date"])
    return d.select("ticker", "date", F.round("mom", 6).alias("mom"), F.round(ranks.impute("vol", "date"), 9).alias("vol"))


def _resid_sql(y: str, x: str, n: str, small: str) -> str:
    return f"""case when count(case when {y} is not null and {x} is not null then 1 end) over d {n} then
  case when {y} is not null and {x} is not null then {y} - regr_intercept({y}, {x}) over d - regr_slope({y}, {x}) over d * {x} end else {small} end"""


@query(f"""with {FACTORS} select ticker, date, round({_resid_sql('vol', 'mom', '>= 20', 'null')}, 6) as vol_rest, round({_resid_sql('vol', 'mom', '> 20', 'vol')}, 6) as vol_orthogonal,
  round(coalesce({_resid_sql('mom', 'size', '>= 20', 'mom')}, mom), 6) as mom_sized from fa window d as (partition by date)""")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What momentum leaves of volatility, with either rule for small dates, and what size leaves of momentum."""
    d = factors(spark, sf_dir)
    return rounded(d.select(
        "ticker", "date", ranks.residual("vol", "mom", ["date"], 20).alias("vol_rest"),
        ranks.residual("vol", "mom", ["date"], 20, strict=True, small=F.col("vol")).alias("vol_orthogonal"),
        F.coalesce(ranks.residual("mom", "size", ["date"], 20, small=F.col("mom")), F.col("mom")).alias("mom_sized"),
    ))


@query(f"""with {FACTORS}, m as (select *, median(mom) over (partition by date) as m from fa), d as (select *, median(abs(mom - m)) over (partition by date) as d from m),
c as (select ticker, date, sector, size, case when mom is not null then greatest(least(mom, m + 3 * 1.4826 * d), m - 3 * 1.4826 * d) end as mom from d),
s as (select ticker, date, sector, round(coalesce({_resid_sql('mom', 'size', '>= 20', 'mom')}, mom), 9) as mom from c window d as (partition by date))
select ticker, date, round(coalesce({pct_sql('mom', 'date', 'sector')}, 0.5), 6) as mom from s""")
def factor_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip, take size out, rank within date and sector."""
    return rounded(panel.factor_pipeline(factors(spark, sf_dir), ["mom"], "size").select("ticker", "date", "mom"))


@query(f"""with {FACTORS}, e as (select date, quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e, count(y) as n from fa group by 1),
b as (select fa.*, e.n, (select count(distinct x) from unnest(e.e) t(x) where x < y) as below from fa join e using (date))
select ticker, date, cast(case when y is null then null when n < 5 then 0 else greatest(below - 1, 0) end as int) as bin,
  cast(case when y is null then null when p <= 0.2 then 0 when p <= 0.4 then 1 when p <= 0.6 then 2 when p <= 0.8 then 3 else 4 end as int) as grade
from (select *, {pct_sql('y', 'date')} as p from b)""")
def qcut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile bins of the next return (dates with fewer than five values: 0) and grades of its percentile rank."""
    d = factors(spark, sf_dir).withColumn("e", ranks.qcut_edges("y", 5, "date")).withColumn("n", F.count("y").over(Window.partitionBy("date")))
    bins = F.when(F.col("y").isNull(), None).when(F.col("n") < 5, 0).otherwise(ranks.bin_of("y", "e"))
    d = d.withColumn("p", ranks.pct_rank("y", "date"))
    return d.select("ticker", "date", bins.cast("int").alias("bin"), ranks.relevance("p").cast("int").alias("grade"))


@query(f"""with {FACTORS}, v as (select *, row_number() over (partition by date order by mom, ticker) as k, count(*) over (partition by date) as n from fa where mom is not null)
select ticker, date, cast(case when n < 10 then null else least((k - 1) // (n // 10), 9) end as int) as decile from v""")
def deciles_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of n // 10 rows; the rest goes to the last."""
    d = factors(spark, sf_dir).filter("mom is not null")
    k, n = F.row_number().over(Window.partitionBy("date").orderBy("mom", "ticker")), F.count("*").over(Window.partitionBy("date"))
    d = d.select("ticker", "date", k.alias("k"), n.alias("n"))
    return d.select("ticker", "date", F.when(F.col("n") >= 10, F.least(F.floor((F.col("k") - 1) / F.floor(F.col("n") / 10)), F.lit(9))).cast("int").alias("decile"))


@query(f"""with {FACTORS}, v as (select * from fa where mom is not null and vol is not null and y is not null),
e1 as (select date, quantile_cont(mom, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from v group by 1),
b1 as (select v.*, greatest((select count(distinct x) from unnest(e) t(x) where x < mom) - 1, 0) as a from v join e1 using (date)),
e2 as (select date, a, quantile_cont(vol, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from b1 group by 1, 2),
b2 as (select b1.*, greatest((select count(distinct x) from unnest(e2.e) t(x) where x < vol) - 1, 0) as b from b1 join e2 using (date, a))
select cast(a as int) as mom_bin, {", ".join(f"round(avg(case when b = {i} then y end), 6) as vol_{i}" for i in range(5))} from b2 group by 1""")
def double_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean next return by bins of momentum and, within each, of volatility."""
    d = factors(spark, sf_dir).filter("mom is not null and vol is not null and y is not null")
    d = d.withColumn("e", ranks.qcut_edges("mom", 5, "date")).withColumn("mom_bin", ranks.bin_of("mom", "e").cast("int"))
    d = d.withColumn("e", ranks.qcut_edges("vol", 5, "date", "mom_bin")).withColumn("b", F.concat(F.lit("vol_"), ranks.bin_of("vol", "e")))
    return rounded(d.groupBy("mom_bin").pivot("b", [f"vol_{i}" for i in range(5)]).agg(F.avg("y")))


@query(f"""with {FACTORS}, k as (select *, row_number() over (partition by date order by mom desc nulls last, ticker) as k, count(*) over (partition by date) as n from fa)
select ticker, date, cast(k as int) as place, k <= 10 as top_10, k <= greatest(1, cast(floor(n * 0.2) as int)) as top_fifth from k where k <= greatest(10, floor(n * 0.2))""")
def top_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten and the first fifth of each date."""
    w = Window.partitionBy("date")
    d = factors(spark, sf_dir).select("ticker", "date", F.row_number().over(w.orderBy(F.desc_nulls_last("mom"), "ticker")).alias("place"), F.count("*").over(w).alias("n"))
    d = d.filter(F.col("place") <= F.greatest(F.lit(10), F.floor(F.col("n") * 0.2)))
    return d.select("ticker", "date", "place", (F.col("place") <= 10).alias("top_10"), (F.col("place") <= ranks.top_count(F.col("n"), 0.2)).alias("top_fifth"))


LARGE, MIDDLE = weights("large"), weights("middle")
OTHER = weights("other")
_NAMES = {"value_rank": "value", "mom_rank": "mom", "long_rank": "long", "vol_rank": "vol", "turn_rank": "turn"}
ALPHA = f"""{FACTORS}, rk as (select *, {", ".join(f"{pct_sql(c, 'date')} as {f}" for f, c in _NAMES.items())} from fa),
al as (select *, case sector when 0 then {" + ".join(f"{f} * {x}" for f, x in LARGE.items())} when 1 then {" + ".join(f"{f} * {x}" for f, x in MIDDLE.items())}
  else {" + ".join(f"{f} * {x}" for f, x in OTHER.items())} end as alpha from rk)"""


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factors() with percentile ranks and the composite score: sector 0 by the large weights, 1 by the middle ones, others alike."""
    d = factors(spark, sf_dir)
    d = d.select("*", *[ranks.pct_rank(c, "date").alias(f) for f, c in _NAMES.items()])
    score = F.when(F.col("sector") == 0, panel.composite(d, LARGE)).when(F.col("sector") == 1, panel.composite(d, MIDDLE)).otherwise(panel.composite(d, OTHER))
    return d.withColumn("alpha", score)


@query(f"with {ALPHA} select ticker, date, round(alpha, 6) as alpha from al")
def composite_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alphas(spark, sf_dir).select("ticker", "date", "alpha"))


@query(f"""with {ALPHA}, x as (select *, round(alpha, 6) as score from al where date = (select max(date) from al)), lo as (select * from x where close <= 3500)
select ticker, date, close, score, cast(row_number() over (order by score desc nulls last, ticker) as int) as place from lo order by place limit 20""")
def low_price_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the latest date, the 20 best under a price cap."""
    d = rounded(alphas(spark, sf_dir).select("ticker", "date", "close", F.round("alpha", 6).alias("score")))
    latest = d.filter(F.col("close") <= 3500).join(F.broadcast(d.agg(F.max("date").alias("date"))), "date")
    top = latest.orderBy(F.desc_nulls_last("score"), "ticker").limit(20)
    return top.select("ticker", "date", "close", "score", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "ticker")).alias("place"))


@query(f"""with {FACTORS}, u as (select *, round(100 * {pct_sql('value', 'date')}, 4) as o from fa), k as (select *, row_number() over (partition by date order by o desc, ticker) - 1 as k, count(*) over (partition by date) as n from u)
select ticker, date, case when k < greatest(1, floor(n * 0.3)) then 'BUY' when k >= n - greatest(1, floor(n * 0.3)) then 'SELL' else 'HOLD' end as direction,
  round(case when k < greatest(1, floor(n * 0.3)) then least(1, 0.5 + 0.5 * o / 100) when k >= n - greatest(1, floor(n * 0.3)) then least(1, 0.5 + 0.5 * (1 - o / 100)) else 0 end, 6) as strength, round(1 - k / n, 6) as percentile from k""")
def universe_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelens.operators.portfolio import rank_universe

    d = factors(spark, sf_dir).withColumn("o", F.round(100 * ranks.pct_rank("value", "date"), 4))
    return rounded(rank_universe(d, "o", ["date"]).select("ticker", "date", "direction", "strength", "percentile"))


@query(f"""with {FACTORS}, k as (select *, row_number() over (partition by date order by size desc, ticker) as k, count(*) over (partition by date) as n,
  row_number() over (partition by date order by vol, ticker) as kv, count(vol) over (partition by date) as nv from fa where vol is not null)
select ticker, date, case when k <= greatest(1, n // 3) then 'large' when k <= 2 * greatest(1, n // 3) then 'mid' else 'small' end as cap,
  vol < max(case when kv = cast(floor(nv * 0.9) as int) + 1 then vol end) over (partition by date) as calm from k""")
def caps_and_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds by size, and whether volatility is under that of the row at int(0.9 n) from below."""
    w = Window.partitionBy("date")
    d = factors(spark, sf_dir).filter("vol is not null")
    d = d.select("ticker", "date", "vol", F.row_number().over(w.orderBy(F.desc("size"), "ticker")).alias("k"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("vol", "ticker")).alias("kv"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    edge = F.max(F.when(F.col("kv") == F.floor(F.col("n") * 0.9) + 1, F.col("vol"))).over(w)
    return d.select("ticker", "date", F.when(F.col("k") <= third, "large").when(F.col("k") <= 2 * third, "mid").otherwise("small").alias("cap"), (F.col("vol") < edge).alias("calm"))


@query(f"""with {FACTORS}, g as (select ticker, round(avg(mom), 8) as m from fa where mom is not null group by 1)
select ticker, round((abs(m) - min(abs(m)) over ()) / (max(abs(m)) over () - min(abs(m)) over () + 1e-9), 6) as share from g""")
def minmax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute means between the least and the largest one."""
    g = factors(spark, sf_dir).filter("mom is not null").groupBy("ticker").agg(F.round(F.avg("mom"), 8).alias("m"))
    a = F.abs(F.col("m"))
    ends = g.agg(F.min(a).alias("low"), F.max(a).alias("high"))  # one row
    return rounded(g.join(F.broadcast(ends)).select("ticker", ((a - F.col("low")) / (F.col("high") - F.col("low") + 1e-9)).alias("share")))


@query(f"""with {FACTORS}, z as (select (mom - avg(mom) over d) / stddev_samp(mom) over d as z from fa where mom is not null window d as (partition by date))
select case when z < -1.5 then 'a' when z < -0.5 then 'b' when z < 0.5 then 'c' when z < 1.5 then 'd' else 'e' end as bucket, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 4) as pct from z group by 1""")
def z_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("date")
    z = factors(spark, sf_dir).filter("mom is not null").select(w_.ratio(F.col("mom") - F.avg("mom").over(w), F.stddev_samp("mom").over(w)).alias("z"))
    bucket = F.when(F.col("z") < -1.5, "a").when(F.col("z") < -0.5, "b").when(F.col("z") < 0.5, "c").when(F.col("z") < 1.5, "d").otherwise("e")
    n = z.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.select("bucket", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("pct"))


@query(f"""with {PM}, d as (select date, row_number() over (order by date) as k, count(*) over () as n from (select distinct date from pm)),
s as (select date, case when k <= floor(n * 0.7) then 'train' when k <= floor(n * 0.7) + floor(n * 0.15) then 'valid' else 'test' end as part from d)
select part, count(*) as n, count(distinct date) as dates, min(date) as first, max(date) as last from pm join s using (date) group by 1""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.time_split(monthly(spark, sf_dir)).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(f"""with {FACTORS} select date, count(*) as n, cast(count_if(mom is not null and long is not null and vol is not null) as bigint) as whole, cast(count_if(mom is not null or long is not null or vol is not null) as bigint) as some from fa group by 1""")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each date, those that lack no factor of three, and those that lack not all."""
    d, three = factors(spark, sf_dir), ["mom", "long", "vol"]
    whole = panel.known(d, three).groupBy("date").agg(F.count("*").alias("whole"))
    some = panel.known(d, three, "all").groupBy("date").agg(F.count("*").alias("some"))
    out = d.groupBy("date").agg(F.count("*").alias("n")).join(whole, "date", "left").join(some, "date", "left")
    return out.select("date", "n", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("whole", "some")])


_ALL = ("mom", "long", "vol", "value", "turn")


@query(f"""with {FACTORS}, m as (select *, {", ".join(f"median({f}) over (partition by date) as m_{f}" for f in _ALL)} from fa),
d as (select *, {", ".join(f"median(abs({f} - m_{f})) over (partition by date) as d_{f}" for f in _ALL)} from m),
c as (select ticker, date, sector, size, {", ".join(f"case when {f} is not null then greatest(least({f}, m_{f} + 3 * 1.4826 * d_{f}), m_{f} - 3 * 1.4826 * d_{f}) end as {f}" for f in _ALL)} from d),
s as (select ticker, date, sector, {", ".join(f"round(coalesce({_resid_sql(f, 'size', '>= 20', f)}, {f}), 9) as {f}" for f in _ALL)} from c window d as (partition by date))
select ticker, date, {", ".join(f"round(coalesce({pct_sql(f, 'date', 'sector')}, 0.5), 6) as {f}" for f in _ALL)} from s""")
def factor_pipeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over all factors: each is clipped, freed of size, and ranked within date and sector."""
    return rounded(panel.factor_pipeline(factors(spark, sf_dir), list(_ALL), "size").select("ticker", "date", *_ALL))


SQL["winsorise_impute_counted"] = SQL["winsorise_impute"]


@query()
def winsorise_impute_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """winsorise_impute by counting, for dates of any size."""
    d = quantiles.winsorise_mad(factors(spark, sf_dir).select("ticker", "date", "mom", "vol"), "mom", ["date"])
    d = quantiles.impute(d, "vol", ["date"])
    return d.select("ticker", "date", F.round("mom", 6).alias("mom"), F.round("vol", 9).alias("vol"))
