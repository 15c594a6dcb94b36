"""Registered queries that train rankers on the factor panel, and the same training in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import ranks
from tidelens.operators import boosting, panel, stats
from tidelens.plans.cross_section import FACTORS, factors
from tidelens.plans.panels import pct_sql, rank_sql, rounded
from tidelens.plans.research import LONG, regimes
from tidelens.plans.research import _ics as factor_ics
from tidelens.sources.shared import delete, saved

QUERIES: dict = {}
SQL: dict[str, str] = {}

FEATURES = ["mom", "long", "vol", "value", "turn", "size"]
BINS = 16
PARAMS = boosting.Params(rounds=6, depth=2, rate=0.1, top=30, ridge=1.0, least=20)
#: Groups of features that the ablation leaves out one by one, and sets that the search compares.
GROUPS = {"momentum": ["mom", "long"], "risk": ["vol"], "value": ["value"], "liquidity": ["turn", "size"]}
SETS = {"momentum": ["mom", "long"], "with risk": ["mom", "long", "vol"], "with value": ["mom", "long", "vol", "value"], "full": FEATURES}
SEEDS = range(1, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, part, x (bins), grade and y of every row whose next return is known. Written once: each training reads it many times."""
    # The split asks for all dates first: with the factors written down, lines are grouped once.
    known, path = saved(factors(spark, sf_dir).filter("y is not null").select("ticker", "date", *FEATURES, "y"), "factors")
    d = panel.time_split(known)
    d = d.select("ticker", "date", "part", boosting.rank_bins(FEATURES, "date", BINS).alias("x"), ranks.relevance(ranks.pct_rank("y", "date")).alias("grade"), "y")
    found, _ = saved(d, "ranking")
    delete(path)
    return found


def _models(d: DataFrame, names: list[str]) -> DataFrame:
    return d.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))


def _ics(scored: DataFrame) -> DataFrame:
    """model, date, ic and n on dates with five rows or more."""
    rank = lambda c: ranks.avg_rank(c, "model", "date")
    pairs = scored.select("model", "date", rank("score").alias("a"), rank("y").alias("b"))
    return pairs.groupBy("model", "date").agg(F.round(stats.corr("a", "b"), 9).alias("ic"), F.count("*").alias("n")).filter("n >= 5")


# The same training in SQL. Tables of a round k: s{k} scores, p{k} pairs, g{k} gradients, h{k}_{level} histograms, c{k}_{level} splits.
BASE = f"""{FACTORS}, dt as (select date, row_number() over (order by date) as k, count(*) over () as n from (select distinct date from fa where y is not null)),
dp as (select date, case when k <= floor(n * 0.7) then 'train' when k <= floor(n * 0.7) + floor(n * 0.15) then 'valid' else 'test' end as part from dt),
fy as (select * from fa join dp using (date) where y is not null),
zs as materialized (select ticker, date, part, [{", ".join(f"least({BINS - 1}, floor(coalesce({pct_sql(f, 'date')}, 0.5) * {BINS}))::int" for f in FEATURES)}] as x,
  case when {pct_sql('y', 'date')} <= 0.2 then 0 when {pct_sql('y', 'date')} <= 0.4 then 1 when {pct_sql('y', 'date')} <= 0.6 then 2 when {pct_sql('y', 'date')} <= 0.8 then 3 else 4 end as grade, y from fy)"""


def _allowed_sql(allowed: dict[str, list[str]] | None) -> str:
    """Which model may split by which feature; none named: all by all."""
    if not allowed:
        return f"al as (select model, unnest(range(1, {len(FEATURES) + 1})) as f from (select distinct model from z))"
    pairs = ", ".join(f"('{m}', {FEATURES.index(f) + 1})" for m, own in allowed.items() for f in own)
    return f"al as (select * from (values {pairs}) v(model, f))"


def training_sql(z: str, allowed: dict[str, list[str]] | None = None, params: boosting.Params = PARAMS) -> str:
    """CTEs from BASE to s{rounds}. z: the SQL of model, ticker, date, part, x, grade and y; rows of part `train` are learned from, all are scored."""
    unit = f"{boosting.UNIT}.0"
    whole = lambda v: f"floor(({v}) * {unit} + 0.5)::bigint"
    worth = lambda g, h: f"({g} / {unit}) * ({g} / {unit}) / ({h} / {unit} + {params.ridge})"
    out = [
        BASE, f"z as materialized ({z})", _allowed_sql(allowed),
        f"""ideal as materialized (select model, date, sum(w order by p) as ideal from (select model, date, p, (power(2.0, grade) - 1) / log2(p + 1.0) as w from
  (select *, row_number() over (partition by model, date order by grade desc) as p from z where part = 'train') where p <= {params.top}) group by 1, 2)""",
        "s0 as materialized (select *, 0.0::double as score from z)",
    ]
    for k in range(params.rounds):
        out += [
            f"t{k} as materialized (select model, date, ticker, grade, score, 1 / log2(p + 1.0) as d from (select *, row_number() over (partition by model, date order by score desc, ticker) as p from s{k} where part = 'train') where p <= {params.top})",
            f"""q{k} as (select r.model, r.date, r.ticker, t.ticker as top, o.ticker is null as beyond, sign(r.grade - t.grade) as side,
  abs(power(2.0, r.grade) - power(2.0, t.grade)) * abs(coalesce(o.d, 0.0) - t.d) / ideal as change, 1 / (1 + exp(sign(r.grade - t.grade) * (r.score - t.score))) as wrong
  from s{k} r join t{k} t on t.model = r.model and t.date = r.date and t.ticker <> r.ticker and t.grade <> r.grade join ideal i on i.model = r.model and i.date = r.date
  left join t{k} o on o.model = r.model and o.date = r.date and o.ticker = r.ticker where r.part = 'train')""",
            f"p{k} as materialized (select model, date, ticker, top, beyond, side::bigint * {whole('wrong * change')} as g, {whole('wrong * (1 - wrong) * change')} as h from q{k})",
            f"""g{k} as materialized (select model, date, ticker, sum(g)::bigint as g, sum(h)::bigint as h from
  (select model, date, ticker, g, h from p{k} union all select model, date, top, -g, h from p{k} where beyond) group by 1, 2, 3)""",
            f"n{k}_0 as materialized (select z.*, coalesce(g, 0) as g, coalesce(h, 0) as h, 1 as node from z left join g{k} using (model, date, ticker))",
        ]
        for level in range(params.depth):
            at = f"{k}_{level}"
            out += [
                f"h{at} as materialized (select model, node, f, x[f] as b, sum(g)::bigint as g, sum(h)::bigint as h, count(*) as n from (select *, unnest(range(1, {len(FEATURES) + 1})) as f from n{at} where part = 'train') group by all)",
                f"""w{at} as (select model, node, f, b, sum(g) over l as gl, sum(h) over l as hl, sum(n) over l as nl, sum(g) over a as g, sum(h) over a as h, sum(n) over a as n
  from h{at} window l as (partition by model, node, f order by b), a as (partition by model, node, f))""",
                f"b{at} as (select *, round({worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')}, {boosting.DIGITS}) as gain from w{at} join al using (model, f) where nl >= {params.least} and n - nl >= {params.least})",
                f"""c{at} as materialized (select a.model, a.node, coalesce(f, 1) as f, coalesce(b, {1 << 30}) as b, coalesce(gain, 0) as gain, coalesce(gl, g0) as gl, coalesce(hl, h0) as hl, coalesce(g - gl, 0) as gr, coalesce(h - hl, 0) as hr
  from (select model, node, sum(g) as g0, sum(h) as h0 from h{at} where f = 1 group by 1, 2) a left join (select * from b{at} where gain > 0 qualify row_number() over (partition by model, node order by gain desc, f, b) = 1) c using (model, node))""",
                f"n{k}_{level + 1} as materialized (select n.* exclude (node), 2 * node + case when x[coalesce(f, 1)] > coalesce(c.b, {1 << 30}) then 1 else 0 end as node, node as above from (select * {'exclude (above)' if level else ''} from n{at}) n left join c{at} c using (model, node))",
            ]
        last = f"{k}_{params.depth - 1}"
        leaf = f"coalesce(round({params.rate} * (case when n.node % 2 = 0 then gl else gr end / {unit}) / (case when n.node % 2 = 0 then hl else hr end / {unit} + {params.ridge}), {boosting.DIGITS}), 0)"
        out.append(f"s{k + 1} as materialized (select s.* exclude (score), round(score + {leaf}, {boosting.DIGITS}) as score from s{k} s join n{k}_{params.depth} n using (model, date, ticker) left join c{last} c on c.model = n.model and c.node = n.above)")
    return "with " + ",\n".join(out)


LAST = f"s{PARAMS.rounds}"


def ndcg_sql(name: str, rows: str) -> str:
    """CTE `name`: k, model, date and ndcg of rows (model, date, score, grade, k)."""
    return f"""{name}_r as (select k, model, date, score, grade::double as g, row_number() over (partition by k, model, date order by score desc) as p, row_number() over (partition by k, model, date order by grade desc) as q from ({rows})),
{name}_d as (select *, avg(case when p <= 10 then 1 / log2(p + 1) else 0 end) over (partition by k, model, date, score) as d from {name}_r),
{name} as (select k, model, date, case when sum(case when q <= 10 then g / log2(q + 1) else 0 end) > 0 then sum(g * d) / sum(case when q <= 10 then g / log2(q + 1) else 0 end) else 0 end as ndcg from {name}_d group by 1, 2, 3)"""


IC = f"""ir as (select model, date, {rank_sql('score', 'model', 'date')} as a, {rank_sql('y', 'model', 'date')} as b from {{0}}),
ics as (select model, date, round(case when not isnan(corr(a, b)) then corr(a, b) end, 9) as ic, count(*) as n from ir group by 1, 2 having count(*) >= 5)"""
ROUNDS = " union all ".join(f"select model, date, score, grade, {k} as k from s{k} where part = 'valid'" for k in range(1, PARAMS.rounds + 1))
CHOSEN = f"""{ndcg_sql("nq", ROUNDS)}, br as (select model, k from (select model, k, round(avg(ndcg), 9) as m from nq group by 1, 2) qualify row_number() over (partition by model order by m desc, k) = 1),
te as materialized ({" union all ".join(f"select s.* from s{k} s join br using (model) where br.k = {k} and part = 'test'" for k in range(1, PARAMS.rounds + 1))})"""


def _split(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(d.filter(F.col("part") == part) for part in ("train", "valid", "test"))


def _trained(d: DataFrame, allowed: dict[str, list[str]] | None = None, choose: bool = False) -> DataFrame:
    """The scored test rows of every model, with the rounds that do best on the validation dates if `choose`."""
    learn, check, test = _split(d)
    forest = boosting.train(learn, FEATURES, allowed, PARAMS)
    if choose:
        forest = boosting.cut(forest, boosting.best_rounds(check, forest, PARAMS.depth))
    return boosting.predict(test, forest, PARAMS.depth)


@query(f"""{training_sql("select 'all' as model, * from zs")}, {CHOSEN}, {IC.format('te')}, {ndcg_sql("mq", "select model, date, score, grade, 0 as k from te")}
select date, round(ic, 6) as ic, round(ndcg, 6) as ndcg, n from ics join mq using (model, date)""")
def ltr_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker trained on the first dates, its rounds chosen on the next, measured on the last: rank ic and NDCG at 10 of each date."""
    scored = _trained(_models(_panel(spark, sf_dir), ["all"]), choose=True)
    ndcg = stats.ndcg(scored.withColumn("gain", F.col("grade").cast("double")), "score", "gain", "date")
    return rounded(_ics(scored).join(ndcg, "date").select("date", "ic", "ndcg", "n"))


@query(f"""{training_sql("select 'all' as model, * from zs")} select ticker, date, round(score, 6) as score, round({pct_sql('score', 'date')}, 6) as place from {LAST} where part = 'test'""")
def ltr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranker's score of every row of the last dates, and its percentile rank within the date."""
    scored = _trained(_models(_panel(spark, sf_dir), ["all"]))
    return rounded(scored.select("ticker", "date", "score", ranks.pct_rank("score", "date").alias("place")))


@query(f"""{training_sql("select 'all' as model, * from zs")}, al2 as ({" union all ".join(f"select f, gain from c{k}_{level} where gain > 0" for k in range(PARAMS.rounds) for level in range(PARAMS.depth))})
select v.feature, coalesce(round(sum(gain), 6), 0) as gain, count(gain) as splits from (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES, 1))}) v(f, feature) left join al2 using (f) group by 1""")
def ltr_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature's splits gained, summed over the trees, and how many there are."""
    learn, _, _ = _split(_models(_panel(spark, sf_dir), ["all"]))
    forest = boosting.train(learn, FEATURES, None, PARAMS)
    return rounded(boosting.importance(spark, forest, FEATURES).select("feature", "gain", "splits"))


REGIMES = "pq as (select date, round(avg(r), 9) as m from pr where r is not null group by 1), rg as (select date, case when m > 0.03 then 'bull' when m < -0.03 then 'bear' else 'flat' end as regime from pq)"


@query(f"""{training_sql("select * from (select 'all' as model, * from zs union all select regime, zs.* from zs join rg using (date))").replace("z as materialized", REGIMES + ", z as materialized", 1)}, {IC.format("(select * from " + LAST + " where part = 'test')")}
select regime, case when model = 'all' then 'all' else 'own' end as model, round(avg(ic), 6) as ic, count(*) as dates from ics join rg using (date) group by 1, 2""")
def ltr_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker for each regime beside one for all: mean rank ic of both on the last dates of each regime. All are trained together."""
    d, (known, _) = _panel(spark, sf_dir), saved(regimes(spark, sf_dir), "regimes")  # read three times
    both = _models(d, ["all"]).unionByName(d.join(F.broadcast(known), "date").withColumnRenamed("regime", "model"))  # one row a date
    found = _ics(_trained(both)).join(F.broadcast(known), "date")
    own = F.when(F.col("model") == "all", "all").otherwise("own").alias("model")
    return rounded(found.groupBy("regime", own).agg(F.avg("ic").alias("ic"), F.count("*").alias("dates")))


ABLATION = {"all": FEATURES} | {f"without {g}": [f for f in FEATURES if f not in own] for g, own in GROUPS.items()}


def _cross_sql(names) -> str:
    return f"select model, zs.* from zs, (values {', '.join(f'({chr(39)}{m}{chr(39)})' for m in names)}) v(model)"


@query(f"""{training_sql(_cross_sql(ABLATION), ABLATION)}, {IC.format("(select * from " + LAST + " where part = 'test')")}, am as (select model, avg(ic) as ic from ics group by 1)
select model, round(ic, 6) as ic, round((select ic from am where model = 'all') - ic, 6) as loss from am""")
def ltr_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank ic without each group of features, and what is lost by leaving it out."""
    found = _ics(_trained(_models(_panel(spark, sf_dir), list(ABLATION)), ABLATION)).groupBy("model").agg(F.avg("ic").alias("ic"))
    whole = found.filter("model = 'all'").select(F.col("ic").alias("whole"))  # one row
    return rounded(found.crossJoin(F.broadcast(whole)).select("model", "ic", (F.col("whole") - F.col("ic")).alias("loss")))


@query(f"""{training_sql(_cross_sql(SETS), SETS).replace("z as materialized", REGIMES + ", z as materialized", 1)}, {IC.format("(select * from " + LAST + " where part = 'test')")}
select model, round(avg(ic), 6) as ic, round(avg(case when regime = 'bull' then ic end), 6) as bull, round(avg(case when regime = 'bear' then ic end), 6) as bear from ics join rg using (date) group by 1""")
def ltr_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of features that grow, each with its own ranker: mean rank ic over the last dates, and over those of rising and of falling markets."""
    found = _ics(_trained(_models(_panel(spark, sf_dir), list(SETS)), SETS)).join(F.broadcast(regimes(spark, sf_dir)), "date")
    of = lambda r: F.avg(F.when(F.col("regime") == r, F.col("ic"))).alias(r)
    return rounded(found.groupBy("model").agg(F.avg("ic").alias("ic"), of("bull"), of("bear")))


SHUFFLED = f"""select 'true' as model, * from zs union all
select 'seed ' || seed, a.ticker, a.date, a.part, a.x, b.grade, a.y from
  (select *, row_number() over (partition by seed, date order by ticker) as k from zs, (select unnest(range({SEEDS[0]}, {SEEDS[-1] + 1})) as seed)) a
  join (select seed, date, grade, row_number() over (partition by seed, date order by md5(seed || ':' || ticker || ':' || date), ticker) as k from zs, (select unnest(range({SEEDS[0]}, {SEEDS[-1] + 1})) as seed)) b using (seed, date, k)"""


@query(f"""{training_sql(SHUFFLED)}, {IC.format("(select * from " + LAST + " where part = 'test')")}, am as (select model, avg(ic) as ic from ics group by 1)
select count(*) as seeds, round(avg(ic), 6) as mean, round(stddev_pop(ic), 6) as deviation, round(avg(ic) + 3 * stddev_pop(ic), 6) as threshold, round(any_value(t.ic_true), 6) as ic,
  any_value(t.ic_true) > avg(ic) + 3 * stddev_pop(ic) and any_value(t.ic_true) > 0.02 as passed
from am, (select ic as ic_true from am where model = 'true') t where model <> 'true'""")
def ltr_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankers refitted on grades that are shuffled within dates, beside the true one: does its rank ic exceed their mean by three deviations, and 0.02?"""
    d = _panel(spark, sf_dir)
    every, _ = saved(_models(d, ["true"]).unionByName(boosting.permuted(d, SEEDS)), "placebo")  # shuffled once, for training and for the test
    found = _ics(_trained(every)).groupBy("model").agg(F.avg("ic").alias("ic"))
    null = F.when(F.col("model") != "true", F.col("ic"))
    out = found.agg(F.count(null).alias("seeds"), F.avg(null).alias("mean"), F.stddev_pop(null).alias("deviation"), F.max(F.when(F.col("model") == "true", F.col("ic"))).alias("ic"))
    out = out.withColumn("threshold", F.col("mean") + 3 * F.col("deviation"))
    return rounded(out.withColumn("passed", (F.col("ic") > F.col("threshold")) & (F.col("ic") > 0.02)))


def _cut_ctes(sql: str, first: str) -> str:
    """The CTEs of `sql` from the one named `first` on."""
    return sql[sql.index(f"{first} as ("):]


@query(f"""{training_sql("select 'all' as model, * from zs")}, {_cut_ctes(LONG, "lg")}, st as (select factor, avg(ic) as ic, avg(ic) / (stddev_pop(ic) + 1e-6) as ir from ics group by 1),
gains as ({" union all ".join(f"select f, gain from c{k}_{level} where gain > 0" for k in range(PARAMS.rounds) for level in range(PARAMS.depth))}),
im as (select v.feature as factor, coalesce(round(sum(gain), 9), 0) as importance from (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES, 1))}) v(f, feature) left join gains using (f) group by 1),
b as (select factor, abs(ic) as a, abs(ir) as b, importance as c from st join im using (factor))
select factor, round(0.4 * (a - min(a) over ()) / (max(a) over () - min(a) over () + 1e-9) + 0.3 * (b - min(b) over ()) / (max(b) over () - min(b) over () + 1e-9) + 0.3 * (c - min(c) over ()) / (max(c) over () - min(c) over () + 1e-9), 5) as score from b""")
def ltr_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors by mean rank ic, information ratio, and what the ranker gains by them."""
    learn, _, _ = _split(_models(_panel(spark, sf_dir), ["all"]))
    gained = boosting.importance(spark, boosting.train(learn, FEATURES, None, PARAMS), FEATURES).select(F.col("feature").alias("factor"), F.col("gain").alias("importance"))
    s = stats.ic_summary(factor_ics(spark, sf_dir), ["factor"]).select("factor", F.col("mean").alias("ic"), "ir").join(gained, "factor")
    return panel.leaderboard(s, "factor", {"ic": 0.4, "ir": 0.3, "importance": 0.3}).withColumn("score", F.round("score", 5))
