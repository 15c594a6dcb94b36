"""Readers and writers, on small files."""

from __future__ import annotations

import json
import sqlite3
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.operators import panel
from tidelens.sources import readers, writers

DAY = date.fromisoformat


@pytest.fixture
def prices(spark):
    return spark.createDataFrame([("a", DAY(f"2024-01-{d:02}"), float(d), g) for d, g in ((1, "x"), (2, "y"), (3, "x"), (9, "x"))], "ticker string, date date, close double, kind string")


def test_a_file_for_each_entity(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"close": [1.0, 2.0]}), tmp_path / "600519.SS.parquet")
    pq.write_table(pa.table({"close": [3.0], "pe": [4.0]}), tmp_path / "AAPL.parquet")
    got = readers.per_entity_files(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("ticker", "close", "pe").collect()), key=str) == [("600519.SS", 1.0, None), ("600519.SS", 2.0, None), ("AAPL", 3.0, 4.0)]
    listed = readers.files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["600519.SS.parquet", "AAPL.parquet"] and all(r.length > 0 for r in listed)


def test_csv_with_comments(spark, tmp_path):
    (tmp_path / "KO_price.csv").write_text("# made by hand\nDate,Close,High,Low,Open,Volume\n# a break\n2020-01-02,1,2,0.5,1,10\n2020-01-03,2,3,1.5,2,20\n")
    got = readers.csv_prices(spark, str(tmp_path / "KO_price.csv"))
    assert got.columns == ["date", "close", "high", "low", "open", "volume"]
    assert [(r.date, r.close, r.volume) for r in got.orderBy("date").collect()] == [(DAY("2020-01-02"), 1.0, 10.0), (DAY("2020-01-03"), 2.0, 20.0)]


def test_json_lines_of_two_ages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "z": NaN}\n{"id": 2, "direction": "PENDING", "extra": {"x": 1}}\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()
    assert got[0].z != got[0].z and got[0].direction is None and got[1].extra.x == 1


def test_nested_documents_and_registry(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"runs": [{"k": 1, "v": 0.5}, {"k": 2, "v": None}]}, indent=1))
    assert sorted(map(tuple, readers.json_documents(spark, str(tmp_path / "b.json"), "runs", "runs array<struct<k: int, v: double>>").collect())) == [(1, 0.5), (2, None)]
    (tmp_path / "r.json").write_text(json.dumps({"mom": {"ic": 0.03, "status": "live"}, "value": {"ic": None}}, indent=1))
    got = readers.registry(spark, str(tmp_path / "r.json"), "ic double, status string").orderBy("name").collect()
    assert [tuple(r) for r in got] == [("mom", 0.03, "live"), ("value", None, None)]


def test_spans(prices):
    at = lambda df: [r.date.day for r in df.orderBy("date").collect()]
    assert at(readers.between(prices, "2024-01-01", "2024-01-03")) == [1, 2, 3]
    assert at(readers.between(prices, "2024-01-01", "2024-01-09", kind="x")) == [1, 3, 9]
    assert at(readers.before(prices, "2024-01-03")) == [1, 2]
    wrong = "x' or '1' = '1"
    assert at(readers.between(prices, "2024-01-01", "2024-01-09", kind=wrong)) == []


def test_jdbc_options(spark, tmp_path):
    """No driver is at hand here: the reader must hand its options on and fail for want of it alone."""
    sqlite3.connect(tmp_path / "x.db").execute("create table t (a int)")
    with pytest.raises(Exception, match="(?i)driver"):
        readers.jdbc(spark, f"jdbc:sqlite:{tmp_path}/x.db", "t").count()


def test_statement_turned(spark):
    d = spark.createDataFrame([("Net Income", 1.0, 2.0), ("Assets", None, 5.0)], "item string, `2023-12-31` double, `2024-03-31` double")
    got = readers.transposed(d).orderBy("report_date").collect()
    assert [(r.report_date, r["Net Income"], r["Assets"]) for r in got] == [(DAY("2023-12-31"), 1.0, None), (DAY("2024-03-31"), 2.0, 5.0)]


def test_company_facts(spark):
    point = lambda end, val, form="10-Q": {"end": end, "val": val, "form": form}
    facts = {
        "ProfitLoss": {"units": {"USD": [point("2023-03-31", 9), point("2023-06-30", 8)]}}, "NetIncomeLoss": {"units": {"USD": [point("2023-03-31", 1), point("2023-03-31", 2), point("2023-09-30", 7, "8-K")]}},
        "Assets": {"units": {}}, "Liabilities": {"units": {"USD": [point("2023-06-30", 4, "10-K")]}}, "Unknown": {"units": {"USD": [point("2023-06-30", 1)]}}, "StockholdersEquity": {},
    }
    got = readers.company_facts(spark.createDataFrame([("a", json.dumps(facts)), ("b", "{}"), ("c", None)], "ticker string, facts string")).orderBy("report_date").collect()
    assert [(r.ticker, str(r.report_date), r.net_income, r.liabilities, r.assets) for r in got] == [("a", "2023-03-31", 2.0, None, None), ("a", "2023-06-30", 8.0, 4.0, None)]


def test_news_once_a_title(spark):
    rows = [("one", DAY("2024-01-02"), "u2"), ("one", DAY("2024-01-01"), "u1"), ("two", DAY("2024-01-03"), "u3"), ("old", DAY("2023-01-03"), "u4")]
    got = readers.recent_news(spark.createDataFrame(rows, "title string, date date, url string"), "2024-01-01", "2024-01-31", 5)
    assert [(r.title, r.url) for r in got.collect()] == [("two", "u3"), ("one", "u1")]


def test_prices_from_their_source(spark, prices, tmp_path):
    asked = {}

    def source(name):
        def load(tickers):
            asked[name] = sorted(tickers)
            return spark.createDataFrame([(t, DAY("2024-01-02"), 1.0) for t in tickers], "ticker string, date date, close double")

        return load

    got = readers.load_prices(spark, ["600519.SS", "AAPL", "000001.SZ"], {"cn": source("cn"), "us": source("us")}, "2024-01-01", "2024-01-31")
    assert got.count() == 3 and asked == {"cn": ["000001.SZ", "600519.SS"], "us": ["AAPL"]}
    (tmp_path / "AAPL_price.csv").write_text("Date,Close,High,Low,Open,Volume\n2020-01-02,1,2,0.5,1,10\n2020-01-03,2,3,1.5,2,20\n")
    of = lambda a, b: readers.load_prices(spark, ["AAPL"], {}, a, b, offline=str(tmp_path)).count()
    assert of("2020-01-03", "2020-01-09") == 1 and of("1999-01-01", "1999-01-02") == 2


def test_writers(spark, prices, tmp_path):
    odd = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], {"a": float("nan")}), (2, 0.5, None, None)], "k int, v double, x array<double>, m map<string, double>")
    odd = odd.withColumn("s", F.struct(F.col("v").alias("w"), F.array(F.struct("v")).alias("deep")))
    writers.json_report(odd, str(tmp_path / "report"))
    lines = sorted((json.loads(x.value) for x in spark.read.text(str(tmp_path / "report")).collect()), key=lambda r: r["k"])
    assert lines[0] == {"k": 1, "v": None, "x": [1.0, None], "m": {"a": None}, "s": {"w": None, "deep": [{"v": None}]}} and lines[1]["s"]["deep"] == [{"v": 0.5}]
    assert panel.normalise(odd).orderBy("k").first().v is None
    writers.sharded_json_lines(prices, str(tmp_path / "shards"), 3, str(tmp_path / "one"))
    assert readers.json_lines(spark, str(tmp_path / "one"), prices.schema).count() == 4 and len(list((tmp_path / "one").glob("part-*"))) == 1
    writers.csv(odd, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).filter("k = 2").first().s == '{"w":0.5,"deep":[{"v":0.5}]}'
    writers.parquet(prices, str(tmp_path / "t"), by=["kind"])
    writers.upsert_parquet(prices.withColumn("close", F.lit(0.0)).limit(2), str(tmp_path / "t"), str(tmp_path / "u"), ["ticker", "date"])
    assert spark.read.parquet(str(tmp_path / "u")).agg(F.count("*"), F.sum("close")).first()[0] == 4
    writers.upsert_parquet(prices, str(tmp_path / "absent"), str(tmp_path / "v"), ["ticker", "date"])
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4


def test_where_to_go_on(spark, prices):
    assert [tuple(r) for r in writers.next_start(prices).collect()] == [("a", DAY("2024-01-10"))]
    months = spark.createDataFrame([("2024-01",), ("2024-02",)], "month string")
    assert [r.month for r in writers.missing_months(months, months.limit(1)).collect()] == ["2024-02"]


def test_shapes(spark):
    d = spark.createDataFrame([("1.5", "x"), ("n/a", "y")], "a string, b string")
    assert [r.a for r in panel.numeric(d, "a").orderBy("b").collect()] == [1.5, None]
    wanted = T._parse_datatype_string("b string, c double, a double")
    assert panel.align(panel.numeric(d, "a"), wanted).schema == wanted
    both = d.select("a", "b", F.col("b").alias("a"))
    assert panel.without_repeats(both).columns == ["a", "b"] and panel.without_repeats(both).count() == 2
    assert [tuple(r) for r in panel.insert_positional(d.limit(0), [("2", "z")]).collect()] == [("2", "z")]
    kept = panel.insert_or_ignore(d, spark.createDataFrame([("9", "x"), ("8", "z"), ("7", "z")], "a string, b string"), ["b"], F.col("a"))
    assert sorted(map(tuple, kept.collect())) == [("1.5", "x"), ("7", "z"), ("n/a", "y")]
