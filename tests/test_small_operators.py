"""Operators whose cases the tables don't hold, on small fixtures with known answers."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidelens.functions import ranks, scoring
from tidelens.functions import windows as w_
from tidelens.operators import ensemble as en
from tidelens.operators import joins, panel, portfolio, stats
from tidelens.plans import backtests

DAY = date.fromisoformat


def test_bust_rule(spark):
    d = spark.createDataFrame([(5.2, 0.5), (5.2, 0.9), (3.0, 0.5), (None, 0.5), (5.2, None)], "de double, cr double")
    strength = F.when(scoring.is_bust("de", "cr"), 0.0).otherwise(scoring.position(F.lit(2.5), F.lit(0.01), F.lit(0.0), F.lit(0.1), F.lit(60.0)))
    regime = F.when(scoring.is_bust("de", "cr"), "FUNDAMENTAL_BUST_OVERRIDE").otherwise("RUNS")
    got = d.select(regime.alias("r"), strength.alias("s")).collect()
    assert (got[0].r, got[0].s) == ("FUNDAMENTAL_BUST_OVERRIDE", 0.0) and all(r.r == "RUNS" and r.s > 0 for r in got[1:])


def test_o_score_is_rounded_at_each_step(spark):
    d = spark.createDataFrame([(10.005, 20.015, 30.1, 40.126, 50.0)], "v double, q double, m double, s double, b double")
    got = d.select(scoring.overall_score(*[F.col(c) for c in "vqmsb"])).first()[0]
    parts = [round(x, 2) for x in (10.005, 20.015, 30.1, 40.126, 50.0)]
    assert got == pytest.approx(round(sum(a * b for a, b in zip((0.25, 0.35, 0.2, 0.1, 0.1), parts)), 2), abs=0.011)


def test_fundamental_ratios(spark):
    row = spark.createDataFrame([(1.0, 10.0, 20.0, 8.0, 5.0, 2.0, 0.5, 4.0), (1.0, 0.0, None, 0.0, 0.0, 2.0, 0.5, 0.0)], "net_income double, revenue double, assets double, liabilities double, equity double, cash_flow double, eps double, price double")
    got = row.select(*[c.alias(k) for k, c in scoring.ratios().items()]).collect()
    assert got[0].asDict() == {"roe": 0.8, "margin": 0.1, "roa": 0.2, "asset_turnover": 0.5, "debt_to_equity": 1.6, "cash_to_liabilities": 0.25, "ep": 0.125, "sp": 2.5, "bp": 1.25}
    assert set(got[1]) == {None}


def test_texts(spark):
    d = spark.createDataFrame([("z: 1, mean_return=-0.0123, std=1", 'x ["a", "b"] y'), ("mean_return= 2e-3", "[1"), ("none", "none")], "a string, b string")
    got = d.select(scoring.mean_return("a").alias("m"), scoring.json_array("b", "array<string>").alias("j")).collect()
    assert [r.m for r in got] == [-0.0123, 0.002, None] and got[0].j == ["a", "b"] and got[2].j is None


def test_exact_mean(spark):
    """Half up at the sixth digit by exact fractions, in whatever order rows come."""
    random.seed(2)
    rows = [(g, round(random.uniform(-1, 1), 8)) for g in range(40) for _ in range(random.choice([2, 4, 5, 8, 16]))] + [(99, None), (99, 0.5)]
    got = spark.createDataFrame(rows, "g int, x double").repartition(7).select("g", "x", ranks.demean_exact("x", "g").alias("e")).collect()
    for r in got:
        if r.x is None:
            assert r.e is None
            continue
        own = [Fraction(str(x)) for g, x in rows if g == r.g and x is not None]
        exact = Fraction(str(r.x)) - sum(own) / len(own)
        assert r.e == pytest.approx(float(math.floor(exact * 10**6 + Fraction(1, 2))) / 1e6, abs=1e-12)


def test_trailing_volatility_of_few_rows(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 0.1), ("a", 3, 0.3), ("b", 1, None)], "ticker string, date int, r double")
    got = {(r.ticker, r.date): r.v for r in d.select("ticker", "date", w_.trailing_volatility("r", w_.series()).alias("v")).collect()}
    assert got["a", 1] == got["a", 2] == got["b", 1] == 0 and got["a", 3] == pytest.approx(0.2 / math.sqrt(2))


def test_left_padding(spark):
    days = [DAY("2024-01-08") + timedelta(k) for k in range(3)]
    d = spark.createDataFrame([("a", x, float(i)) for i, x in enumerate(days)] + [("b", DAY("2024-01-01") + timedelta(k), float(k)) for k in range(9)], "ticker string, date date, close double")
    got = panel.left_padded(d, 6).orderBy("ticker", "date").collect()
    a = [(r.date, r.close) for r in got if r.ticker == "a"]
    assert a == [(DAY("2024-01-03"), 0.0), (DAY("2024-01-04"), 0.0), (DAY("2024-01-05"), 0.0), *zip(days, (0.0, 1.0, 2.0))]
    assert [r.close for r in got if r.ticker == "b"] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


def test_thinning_and_slicing(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, float(i)) for i in range(3)], "ticker string, date int, x double")
    got = panel.every_kth(d, 3).collect()
    assert sorted(r.date for r in got if r.ticker == "a") == [0, 3, 6, 9] and sorted(r.date for r in got if r.ticker == "b") == [0, 1, 2]
    rows = spark.createDataFrame([("a", DAY("2024-01-01"), 1.0), ("a", DAY("2024-01-02"), 2.0), ("b", DAY("2024-01-02"), 3.0)], "ticker string, date date, x double")
    m = panel.slicer(rows, "x", ["2024-01-01", "2024-01-02"])
    assert m.columns == ["ticker", "2024-01-02", "2024-01-01"] and sorted(map(tuple, m.collect())) == [("a", 2.0, 1.0), ("b", 3.0, 0.0)]


def test_numbers_over_parts(spark):
    d = spark.createDataFrame([(i * 7 % 501, "x") for i in range(501)], "k int, v string").repartition(5)
    assert sorted((r.k, r.i) for r in panel.numbered(d, ["k"], "i").collect()) == [(i, i) for i in range(501)]


def test_next_tokens(spark):
    logits = {"a": 2.0, "b": 1.0, "c": 1.0, "d": -1.0, "e": -3.0}
    d = spark.createDataFrame([(1, t, x) for t, x in logits.items()], "g int, token string, logit double")
    of = lambda **k: {r.token: r.share for r in en.top_k_top_p(d, ["g"], "logit", "token", **k).collect()}
    weight = {t: math.exp(x) for t, x in logits.items()}
    assert of() == pytest.approx({t: x / sum(weight.values()) for t, x in weight.items()})
    assert set(of(top_k=2)) == {"a", "b", "c"}  # ties with the last stay
    assert set(of(top_p=0.1)) == {"a"} and set(of(top_p=0.7)) == {"a", "b"} and sum(of(top_p=0.7).values()) == pytest.approx(1)
    shares = en.top_k_top_p(d, ["g"], "logit", "token", top_k=3)
    at = lambda u: en.drawn(shares, ["g"], "token", F.lit(u)).first().token
    assert (at(0.0), at(0.5), at(0.6), at(0.99)) == ("a", "a", "b", "c")


def test_ensemble_takes_more_samples_near_a_boundary(spark):
    def path(key, sample, end):
        return [(key, sample, t, 100 + (end - 100) * t / 2, 101.0 + sample, 99.0 - sample) for t in range(3)]

    calm = [r for s in range(1, 6) for r in path("calm", s, 100.0)]
    close = [r for s in range(1, 6) for r in path("close", s, 100 * (1 + 0.0309 * 0.95))]
    short = [r for s in range(1, 3) for r in path("short", s, 100 * (1 + 0.0309 * 0.95))]
    got = {r.key: r for r in en.ensemble(spark.createDataFrame(calm + close + short, "key string, sample int, step int, close double, high double, low double"), ["key"]).collect()}
    assert (got["calm"].n_samples, got["close"].n_samples, got["short"].n_samples) == (3, 5, 2)
    assert got["close"].mean_return == pytest.approx(0.0309 * 0.95) and got["calm"].predicted_max == 103 and got["calm"].predicted_range == pytest.approx(0.06)


def test_ensemble_broadcasts_no_table_of_keys(spark):
    """However few bytes the keys are taken for: what a plan thinks small may be every forecast. A key that is NULL, or has no early sample, has none."""
    rows = [(k, s, t, 100.0 + t, 101.0 + s, 99.0 - s) for k in ("a", "b", None) for s in range(1, 6) for t in range(3)] + [("late", 4, 0, 100.0, 101.0, 99.0)]
    found = en.ensemble(spark.createDataFrame(rows, "key string, sample int, step int, close double, high double, low double"), ["key"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.n_samples for r in found.collect()} == {"a": 3, "b": 3}


def test_bootstrap_draws(spark):
    """The same draws, by the same hash, in plain Python."""
    random.seed(1)
    rows = [(f"t{i:03}", random.choice([1, -1]), round(random.uniform(-0.1, 0.1), 6)) for i in range(60)]
    got = stats.bootstrap_spread(spark.createDataFrame(rows, "id string, side int, y double").repartition(4), "side", "y", "id", 40, 7).first()
    ids = spark.range(60).crossJoin(spark.range(1, 41).withColumnRenamed("id", "b")).select("b", F.pmod(F.xxhash64("id", "b", F.lit(7).cast("long")), F.lit(60).cast("long")).alias("k")).collect()
    spreads = []
    for b in range(1, 41):
        own = [rows[r.k] for r in ids if r.b == b]
        assert len(own) == 60
        mean = lambda s: sum(y for _, x, y in own if x == s) / sum(x == s for _, x, _ in own)  # noqa: E731, B023
        spreads.append(mean(1) - mean(-1))
    assert got.mean == pytest.approx(sum(spreads) / 40) and got.low == pytest.approx(sorted(spreads)[1]) and got.high == pytest.approx(sorted(spreads)[39])


def test_total_losses_and_missing_rows(spark):
    """What is held and has no price on the next date is lost, whether the join or the row's own next row says so."""
    at = [DAY("2024-01-01"), DAY("2024-02-01"), DAY("2024-03-01")]
    prices = spark.createDataFrame([("a", at[0], 1.0), ("a", at[1], 2.0), ("a", at[2], 1.0), ("b", at[0], 4.0), ("b", at[2], 5.0)], "ticker string, date date, close double")
    dates = portfolio.rebalance_dates(prices)
    joined = portfolio.held_returns(prices, prices, dates)
    held = prices.withColumns({"next_row": F.lead("date").over(w_.series()), "next_close": F.lead("close").over(w_.series())})
    own = portfolio.held_to_next(held, dates)
    of = lambda df: sorted((r.ticker, r.date, r.ret) for r in df.collect())
    assert of(joined) == of(own) == [("a", at[0], 1.0), ("a", at[1], -0.5), ("b", at[0], -1.0)]
    members = spark.createDataFrame([(t, k) for k, ts in enumerate(["abc", "bcd", "x"]) for t in ts], "ticker string, turn long")
    assert [(r.turn, r.kept) for r in portfolio.overlap(members, 0).orderBy("turn").collect()] == [(1, 2 / 3), (2, 0.0)]


def test_months_without_rows(spark):
    d = spark.createDataFrame([("a", DAY("2024-01-30"), 1.0), ("a", DAY("2024-03-02"), 2.0), ("a", DAY("2024-03-20"), None)], "ticker string, date date, close double")
    got = panel.resample_month(d, "close").orderBy("month_end").collect()
    assert [(str(r.month_end), r.close) for r in got] == [("2024-01-31", 1.0), ("2024-02-29", None), ("2024-03-31", 2.0)]


def test_scalars_as_of_a_date(spark):
    rows = spark.createDataFrame([(DAY("2024-01-02"), 1.0), (DAY("2024-01-05"), 2.0)], "date date, v double")
    asked = spark.createDataFrame([(DAY("2024-01-01"),), (DAY("2024-01-02"),), (DAY("2024-01-09"),)], "at date")
    assert [r.v for r in joins.asof_scalar(asked, rows, "at", "date", ["v"]).orderBy("at").collect()] == [None, 1.0, 2.0]


def test_unknown_indicators(spark):
    d = spark.createDataFrame([("a", DAY("2024-01-02"), 1.0)], "ticker string, date date, close double")
    with pytest.raises(ValueError, match="nope"):
        panel.indicator_rows(d, "ticker", "date", {"close": F.col("close")}, ("close", "nope"), 3)
    got = panel.indicator_rows(d, "ticker", "date", {"close": F.col("close")}, ("close",), 2).orderBy("date").collect()
    assert [(r.value, r.status) for r in got] == [(None, "N/A"), (None, "N/A"), (1.0, "ok")]


def test_sign_words(spark):
    random.seed(3)
    x = [random.choice([-1.0, 1.0]) for _ in range(70)]
    words = spark.createDataFrame([(x,)], "x array<double>").select(scoring.sign_words("x", 32)).first()[0]
    assert words == [sum((v > 0) << i for i, v in enumerate(x[k : k + 32])) for k in (0, 32, 64)]


def test_signals_that_may_be_traded(spark):
    rows = [("BUY", 1.0, None, True), ("SELL", -1.0, "", True), ("HOLD", 1.0, None, False), ("BUY", None, None, False), ("SELL", 2.0, "lost", False), (None, 1.0, None, False)]
    d = spark.createDataFrame(rows, "direction string, z double, error string, want boolean").withColumn("got", portfolio.valid())
    assert d.filter("got <> want or got is null").count() == 0


def test_rows_that_lack_any_or_all(spark):
    d = spark.createDataFrame([(1, 1.0, 1), (2, None, 2), (3, float("nan"), None), (4, None, None)], "i int, a double, b int")
    of = lambda how: sorted(r.i for r in panel.known(d, ["a", "b"], how).collect())
    assert of("any") == [1] and of("all") == [1, 2]


def test_sharpe_of_the_curves_changes(spark):
    import numpy as np
    import pandas as pd

    r = [0.1, -0.05, 0.02, 0.3, -0.2]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(r)] + [("b", 0, 0.1)], "g string, date int, r double")
    got = {x.g: (x.n, x.sharpe) for x in portfolio.nav_sharpe(d, "r", ["g"]).collect()}
    change = (1 + pd.Series(r)).cumprod().pct_change().dropna()
    assert got["a"] == (4, pytest.approx(np.sqrt(12) * change.mean() / change.std())) and got["b"] == (0, None)


def test_company_numbers(spark):
    from tidelens.sources import readers

    lookup = spark.createDataFrame([("AAPL", 320193), ("aapl", 320193), ("MSFT", 789019)], "ticker string, cik_str long")
    got = {r.ticker: r.cik for r in readers.with_cik(spark.createDataFrame([("aapl",), ("XX",), (None,)], "ticker string"), lookup).collect()}
    assert got == {"aapl": "0000320193", "XX": None, None: None}


def test_slices_of_all_dates(spark):
    from datetime import date

    rows = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 3), 2.0), ("b", date(2024, 1, 3), 3.0)], "ticker string, date date, x double")
    m = panel.slicer(rows, "x")
    assert m.columns == ["ticker", "2024-01-03", "2024-01-01"] and sorted(map(tuple, m.collect())) == [("a", 2.0, 1.0), ("b", 3.0, 0.0)]


def test_rows_without_a_dimension_stay(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "d")], "ticker long, x string")
    dim = spark.createDataFrame([(1, "one"), (3, None), (9, "nine")], "ticker long, sector_name string")
    got = joins.with_dimension(p, dim, ["ticker"], {"sector_name": "UNKNOWN"}).collect()
    assert sorted(got, key=str) == sorted([(1, "a", "one"), (2, "b", "UNKNOWN"), (3, None, "UNKNOWN"), (None, "d", "UNKNOWN")], key=str)


def test_left_dimensions_reads_all_suppliers(spark, tmp_path):
    """Suppliers in debt have sectors too; a month of 50 suppliers is wide, one of 49 isn't."""
    spark.createDataFrame([(0, "ALGERIA", 0), (1, "BRAZIL", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, i % 2, float(i - 25)) for i in range(50)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(i, DAY(f"2024-0{month}-15"), 10.0, 1.0, 0.0) for month in (1, 2) for i in range(51 - month)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.ticker, r.date): (r.sector_name, r.regime) for r in backtests.left_dimensions(spark, str(tmp_path)).collect()}
    assert got == {(i, DAY(f"2024-0{month}-01")): (("ALGERIA", "BRAZIL")[i % 2], "wide" if month == 1 else None) for month in (1, 2) for i in range(51 - month)}


def test_left_dimensions_keeps_lines_without_a_supplier(spark, tmp_path):
    """Lines of a supplier, or of a nation, that isn't in the tables stay as UNKNOWN and count for the month's width; so they do in SQL."""
    import duckdb

    spark.createDataFrame([(0, "ALGERIA", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, 0 if i < 47 else 9, 1.0) for i in range(48)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(i, DAY(f"2024-0{month}-15"), 10.0, 1.0, 0.0) for month in (1, 2) for i in [*range(48, 47 + month), *range(48), None]]
    spark.createDataFrame([*lines, (48, DAY("2024-02-01"), 10.0, 1.0, 0.0)], "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in backtests.left_dimensions(spark, str(tmp_path)).select("ticker", "date", "sector_name", "regime").collect()]
    want = [(i, DAY(f"2024-0{month}-01"), "ALGERIA" if i is not None and i < 47 else "UNKNOWN", (None, "wide")[month - 1]) for month in (1, 2) for i in [*range(47 + month), None]]
    assert sorted(got, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    theirs = con.execute(f"select ticker, date, sector_name, regime from ({backtests.SQL['left_dimensions']})").fetchall()
    assert sorted(theirs, key=str) == sorted(want, key=str)
