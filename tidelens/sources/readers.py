"""Readers: every source becomes a typed table. No schema is inferred where one is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double"

#: Financial concepts and their names in filings, in the order in which they are tried. Fixed values.
CONCEPTS = {
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "assets": ["Assets"],
    "liabilities": ["Liabilities"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "eps": ["EarningsPerShareDiluted"],
}
FORMS = ("10-Q", "10-K")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def per_entity_files(spark: SparkSession, path: str, entity: str = "ticker") -> DataFrame:
    """A folder with one Parquet file an entity, named after it; files may have different columns."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.withColumn(entity, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))


def csv_prices(spark: SparkSession, path: str | list[str], schema: str = "Date date, Close double, High double, Low double, Open double, Volume double") -> DataFrame:
    """A CSV with a header, where lines that begin with # are comments."""
    df = spark.read.schema(schema).csv(path, header=True, comment="#", enforceSchema=False)
    return df.toDF(*[c.lower() for c in df.columns])


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One object a line. Without a schema that of all lines together; bare NaN is read."""
    reader = spark.read.option("allowNonNumericNumbers", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def json_documents(spark: SparkSession, path: str, rows: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole-file JSON, with one row for each element of the array at `rows`."""
    reader = spark.read.option("multiLine", "true").option("allowNonNumericNumbers", "true")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def between(df: DataFrame, first: str, last: str, date: str = "date", **equal: str) -> DataFrame:
    """Rows from first to last, both included, with the given values. The bounds are literals of the plan, never pasted into SQL text."""
    out = df.filter(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    for c, v in equal.items():
        out = out.filter(F.col(c) == F.lit(v))
    return out


def before(df: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    """Rows strictly before a date: what was known then."""
    return df.filter(F.col(date) < F.lit(cutoff).cast("date"))


def transposed(df: DataFrame, item: str = "item") -> DataFrame:
    """A statement with items as rows and period ends as columns, turned: one row a period (report_date), one column an item."""
    periods = [c for c in df.columns if c != item]
    long = df.unpivot([item], periods, "report_date", "value")
    names = [r[0] for r in df.select(item).distinct().orderBy(item).collect()]  # the items of one statement
    return long.groupBy(F.to_date("report_date").alias("report_date")).pivot(item, names).agg(F.first("value"))


def company_facts(df: DataFrame, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Filings as one row a ticker and period end, with a column for each concept.

    df: ticker and facts, a JSON object of concept names, each with units, each with points of end, val and form. Of a concept's names the
    first with a point for the period wins, of its units the first, and of equal period ends the last point.
    """
    point = T.ArrayType(T.StructType([T.StructField("end", T.StringType()), T.StructField("val", T.DoubleType()), T.StructField("form", T.StringType())]))
    unit = T.StructType([T.StructField("units", T.MapType(T.StringType(), point))])
    facts = df.select("ticker", F.explode(F.from_json("facts", T.MapType(T.StringType(), unit))).alias("name", "fact"))
    first_unit = F.try_element_at(F.map_values("fact.units"), F.lit(1))
    points = facts.select("ticker", "name", F.posexplode(first_unit).alias("at", "p")).filter(F.col("p.form").isin(list(forms)))
    points = points.groupBy("ticker", "name", F.to_date("p.end").alias("report_date")).agg(F.max_by("p.val", "at").alias("val"), F.max_by("p.form", "at").alias("form"))
    value = {c: F.coalesce(*[F.max(F.when(F.col("name") == n, F.col("val"))) for n in names]) for c, names in CONCEPTS.items()}
    wanted = [n for names in CONCEPTS.values() for n in names]
    return points.filter(F.col("name").isin(wanted)).groupBy("ticker", "report_date").agg(F.max("form").alias("form"), *[v.alias(c) for c, v in value.items()])


def recent_news(news: DataFrame, first: str, last: str, limit: int | None = None, key: str = "title", date: str = "date") -> DataFrame:
    """News of a span, one of each title (the earliest, then by url), newest first."""
    w = Window.partitionBy(key).orderBy(date, "url")
    out = between(news, first, last, date).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return out.orderBy(F.desc(date), key).limit(limit) if limit else out


def with_cik(df: DataFrame, lookup: DataFrame, ticker: str = "ticker") -> DataFrame:
    """df with its tickers' ten-digit company numbers, NULL where lookup (ticker, cik_str) has none; tickers are compared in capitals."""
    known = lookup.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik")).dropDuplicates(["_t"])
    return df.join(known, F.upper(ticker) == F.col("_t"), "left").drop("_t")


def route(ticker: Column) -> Column:
    """Which source a ticker's prices come from."""
    return F.when(ticker.rlike(r"\.(SS|SZ)$"), "cn").otherwise("us")


def files(spark: SparkSession, path: str, pattern: str = "*.parquet", limit: int = 200) -> DataFrame:
    """path, size and modification time of the files below a folder, by name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", "modificationTime").orderBy("path").limit(limit)


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of named entries as one row an entry: name, and the fields of `schema`."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", T.MapType(T.StringType(), T._parse_datatype_string(schema)), {"allowNonNumericNumbers": "true"})
    return text.select(F.explode(entries).alias("name", "_e")).select("name", "_e.*")


def offline_prices(spark: SparkSession, folder: str, tickers: str | list[str], first: str, last: str) -> DataFrame:
    """The tickers' local price files between two dates, by one scan; of a ticker that has nothing between them the whole file."""
    own = [tickers] if isinstance(tickers, str) else tickers
    rows = csv_prices(spark, [f"{folder}/{t}_price.csv" for t in own]).withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_price\.csv$", 1))
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    found = rows.groupBy("ticker").agg(F.count_if(inside).alias("_n"))
    return rows.join(found, "ticker").filter(inside | (F.col("_n") == 0)).drop("_n").select(*[c for c in rows.columns if c != "ticker"], "ticker")


def load_prices(spark: SparkSession, tickers: list[str], sources: dict[str, Callable[[list[str]], DataFrame]], first: str, last: str, offline: str | None = None) -> DataFrame:
    """Prices of the tickers, each from its source: what route() says, or the local files below `offline`. Columns that a source lacks are NULL."""
    if offline:
        return offline_prices(spark, offline, tickers, first, last)
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string").select("ticker", route(F.col("ticker")).alias("source")).collect()
    parts = [between(sources[s]([r["ticker"] for r in names if r["source"] == s]), first, last) for s in sorted({r["source"] for r in names})]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
