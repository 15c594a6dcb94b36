"""Operators on whole panels: cleaning, winsorising, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.ranks import avg_rank, clip, pct_rank, residual
from tidelens.operators.scan import ewm  # noqa: F401  (smoothing is part of a panel's operators)


def normalise(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns as NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, missing ones NULL."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def numeric(df: DataFrame, *names: str) -> DataFrame:
    """Columns as doubles; what isn't a number is NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in names})


def long_enough(df: DataFrame, least: int, entity: str = "ticker") -> DataFrame:
    """The entities with at least `least` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(entity))).filter(F.col("_n") >= least).drop("_n")


def last_of_month(df: DataFrame, entity: str = "ticker", date: str = "date") -> DataFrame:
    """The last row of each entity in each month."""
    w = Window.partitionBy(entity, F.trunc(date, "MM")).orderBy(F.desc(date))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def resample_month(df: DataFrame, value: str, entity: str = "ticker", date: str = "date") -> DataFrame:
    """The last known value of every calendar month from the first to the last one, dated at the month's end; empty months are NULL."""
    months = df.groupBy(entity, F.last_day(date).alias("month_end")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date))).alias(value))
    span = months.groupBy(entity).agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    spine = span.select(entity, F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m")).select(entity, F.last_day("m").alias("month_end"))
    return spine.join(months, [entity, "month_end"], "left")


def winsorise_mad(df: DataFrame, x: str, group: list[str], k: float = 3.0, out: str | None = None) -> DataFrame:
    """Clip to the group's median plus or minus k * 1.4826 times the median absolute deviation."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_m", F.median(x).over(w)).withColumn("_d", F.median(F.abs(F.col(x) - F.col("_m"))).over(w))
    reach = F.lit(k * 1.4826) * F.col("_d")
    return df.withColumn(out or x, clip(x, F.col("_m") - reach, F.col("_m") + reach)).drop("_m", "_d")


def factor_pipeline(df: DataFrame, factors: list[str], size: str, date: str = "date", sector: str = "sector", least: int = 20) -> DataFrame:
    """For each factor: clip by MAD within the date, take size out of it, then rank within date and sector (NULL: 0.5), overwriting it each time."""
    for f in factors:
        df = winsorise_mad(df, f, [date])
        df = df.withColumn(f, F.coalesce(residual(f, size, [date], least, small=F.col(f)), F.col(f)))
        df = df.withColumn(f, F.coalesce(pct_rank(f, date, sector), F.lit(0.5)))
    return df


def composite(df: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted sum of the factors that df has; a NULL factor makes it NULL."""
    out = F.lit(0.0)
    for f, w in weights.items():
        if f in df.columns:
            out = out + F.col(f) * w
    return out


def null_rates(df: DataFrame) -> DataFrame:
    """column and null_rate of every column, in one pass."""
    rates = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in df.columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in df.columns])).alias("x")).select("x.*")


def keep_newest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: list[str], new_wins: bool = True) -> DataFrame:
    """Old and new rows, one a key: the new one (or the old one)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_newest(both, key, F.desc("_new") if new_wins else F.asc("_new")).drop("_new")


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """table and those first rows of new whose key it doesn't have."""
    return table.unionByName(keep_newest(new, key, order).join(table, key, "left_anti").select(*table.columns))


def time_split(df: DataFrame, shares: tuple[float, float] = (0.7, 0.15), date: str = "date") -> DataFrame:
    """`part` by distinct dates: train, valid and test, with whole-number floors. The dates are few, so their ranks are joined back."""
    dates = df.select(date).distinct()
    one = Window.orderBy(date)  # one row a date
    ranked = dates.select(date, F.row_number().over(one).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    a, b = (F.floor(F.col("n") * F.lit(s)) for s in shares)
    part = F.when(F.col("k") <= a, "train").when(F.col("k") <= a + b, "valid").otherwise("test")
    return df.join(F.broadcast(ranked.select(date, part.alias("part"))), date)


def spearman(x: str, y: str, group: str) -> tuple[Column, Column]:
    """Ranks of the pairs that are both known."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return avg_rank(F.when(both, F.col(x)), group), avg_rank(F.when(both, F.col(y)), group)


def indicator_rows(df: DataFrame, entity: str, date: str, known: dict[str, Column], chosen: tuple[str, ...], days: int) -> DataFrame:
    """entity, date, indicator, value and status of the chosen indicators on every calendar day of each entity's last `days` days; a day without a row is N/A."""
    wrong = [c for c in chosen if c not in known]
    if wrong:
        raise ValueError(f"no indicator is called {', '.join(wrong)}; there are {', '.join(sorted(known))}")
    wide = df.select(entity, date, F.array(*[known[c].cast("double") for c in chosen]).alias("_v"))
    span = df.groupBy(entity).agg(F.max(date).alias("_last"))
    spine = span.select(entity, F.explode(F.sequence(F.date_sub("_last", days), F.col("_last"))).alias(date))
    out = spine.join(wide, [entity, date], "left")
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in chosen]).alias("indicator"), F.coalesce("_v", F.array_repeat(F.lit(None).cast("double"), len(chosen))).alias("value"))
    status = F.when(F.col("_v").isNull(), "N/A").otherwise("ok").alias("status")
    return out.select(entity, date, status, F.explode(pairs).alias("_p")).select(entity, date, "_p.indicator", "_p.value", "status")


def leaderboard(df: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """name and score: the weighted min-max shares of the columns' absolute values. df: one row a factor."""
    w = Window.partitionBy(F.lit(1))
    score = F.lit(0.0)
    for c, weight in weights.items():
        a = F.abs(F.col(c))
        score = score + weight * (a - F.min(a).over(w)) / (F.max(a).over(w) - F.min(a).over(w) + 1e-9)
    return df.select(name, score.alias("score"))


def left_padded(df: DataFrame, length: int, entity: str = "ticker", date: str = "date") -> DataFrame:
    """Each entity's last `length` rows; a shorter series begins with copies of its first row on the business days before it."""
    values = [c for c in df.columns if c not in (entity, date)]
    w = Window.partitionBy(entity)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc(date)))).filter(F.col("_k") <= length)
    first = rows.withColumn("_n", F.count("*").over(w)).filter((F.col("_k") == F.col("_n")) & (F.col("_n") < length))
    # Of so many calendar days before the first row the last business days are enough.
    days = F.filter(F.sequence(F.date_sub(date, 2 * length + 7), F.date_sub(date, 1)), lambda x: F.weekday(x) < 5)
    short = F.col("_n") - length  # below 0
    pads = first.select(entity, F.explode(F.slice(days, short.cast("int"), F.lit(length) - F.col("_n"))).alias(date), *values)
    return rows.drop("_k").select(entity, date, *values).unionByName(pads)


def every_kth(df: DataFrame, most: int = 500, entity: str = "ticker", date: str = "date") -> DataFrame:
    """About `most` rows of each entity for a chart: every k-th with k = max(1, n // most), from the first."""
    w = Window.partitionBy(entity)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return df.withColumns({"_i": F.row_number().over(w.orderBy(date)) - 1, "_s": k}).filter(F.col("_i") % F.col("_s") == 0).drop("_i", "_s")


def known(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    """Rows without those that lack any of the columns, or all of them; NaN counts as missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    missing = [(F.col(c).isNull() | F.isnan(c)) if c in floats else F.col(c).isNull() for c in columns]
    out = missing[0]
    for m in missing[1:]:
        out = (out | m) if how == "any" else (out & m)
    return df.filter(~out)


def without_repeats(df: DataFrame) -> DataFrame:
    """The first of columns that share a name."""
    names = df.columns
    numbered = df.toDF(*[str(i) for i in range(len(names))])
    keep = {}
    for i, c in enumerate(names):
        keep.setdefault(c, i)
    return numbered.select(*[F.col(str(i)).alias(c) for c, i in keep.items()])


def insert_positional(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """table and rows whose values stand in the order of its columns."""
    return table.union(table.sparkSession.createDataFrame(rows, table.schema))


def slicer(df: DataFrame, field: str, dates: list[str] | None = None, entity: str = "ticker", date: str = "date") -> DataFrame:
    """One field as a matrix of entities and the given dates (all there are, if none are), newest first; what is missing is 0."""
    if dates is None:
        dates = [r[0] for r in df.select(F.date_format(date, "yyyy-MM-dd")).distinct().collect()]  # one row a date
    shown = sorted(dates, reverse=True)
    d = df.withColumn("_d", F.date_format(date, "yyyy-MM-dd")).filter(F.col("_d").isin(shown))
    return d.groupBy(entity).pivot("_d", shown).agg(F.first(field)).na.fill(0.0)


def _finite(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _finite(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_finite(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x


def finite(df: DataFrame) -> DataFrame:
    """normalise() at any depth of arrays, maps and structs."""
    return df.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in an order, without one task for all: each part of a range sort counts its own rows."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    spread = spread.withColumn("_part", F.shiftright("_id", 33))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_from"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = sizes.select("_part", "_from", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return spread.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.col("_from")).drop("_id", "_part", "_from", "_before")
