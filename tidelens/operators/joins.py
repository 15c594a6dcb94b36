"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of one key's time line that a task should have; a longer line is cut into slices of time.
ROWS = 1 << 20


def _number(at: Column, kind: T.DataType) -> Column:
    """A time as a number in the same order."""
    return at.cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(at.cast("timestamp")).cast("double")


def _long_lines(line: DataFrame, by: list[str], rows: int) -> DataFrame | None:
    """Keys with more than `rows` rows: by, _low, _span and _pieces. None if there is none, which is plain where the plan's estimate allows no more than `rows`."""
    size = int(str(line._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= 16 * rows:
        return None
    at = _number(F.col("_t"), line.schema["_t"].dataType)
    spans = line.groupBy(*by).agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).filter(F.col("_n") > rows)
    long = spans.select(*by, "_low", (F.col("_high") - F.col("_low")).alias("_span"), F.ceil(F.col("_n") / rows).alias("_pieces"))
    return None if long.isEmpty() else long


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], rows: int = ROWS) -> DataFrame:
    """For each left row the right row of the same key with the greatest time at most its own (equal times match), else NULLs.

    Both sides are put on one time line for each key and the last right row is carried on: one shuffle on the key and no
    inequality join. Of right rows with one time any one may win, so their times should differ within a key.

    A key with more than `rows` rows is cut into slices of time, each a task's work; the last right row of each slice is carried on to the
    next ones by a table of one row a slice. Without keys (by = []) all rows are one line. A slice in which all times are alike stays whole.
    """
    row = F.struct(*values)
    a = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), row.alias("_r"))
    line, last = a.unionByName(b), F.last("_r", ignorenulls=True)
    long = _long_lines(line, by, rows)
    if long is None:
        w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = line.withColumn("_r", last.over(w))
    else:
        cut = line.join(long, by, "left") if by else line.crossJoin(F.broadcast(long))  # without keys `long` is one row
        place = F.floor((_number(F.col("_t"), line.schema["_t"].dataType) - F.col("_low")) / (F.col("_span") * (1 + 1e-12) + 1e-9) * F.col("_pieces")).cast("long")
        cut = cut.withColumn("_slice", F.coalesce(place, F.lit(0).cast("long"))).drop("_low", "_span", "_pieces")
        w = Window.partitionBy(*by, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = cut.withColumn("_r", last.over(w)).join(_carried(cut, long, by), [*by, "_slice"], "left").withColumn("_r", F.coalesce("_r", "_before"))
    return found.filter("_side = 1").select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in values])


def _carried(cut: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    """by, _slice and _before: the last right row before each slice of the long lines. One row a slice, each of about as many rows as a task has."""
    ends = cut.filter("_side = 0").groupBy(*by, "_slice").agg(F.max_by("_r", "_t").alias("_end"))
    slices = long.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces"))).alias("_slice"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.join(ends, [*by, "_slice"], "left").select(*by, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))


def nth_row_after(events: DataFrame, prices: DataFrame, hold: int, entity: str = "ticker", date: str = "date", price: str = "close") -> DataFrame:
    """entry_date, entry, exit_date and exit of each event: the first price row after its date, and the one `hold` rows on.

    The price rows know their own later rows, and an event takes the last row at or before its date (or the row that opens the series).
    """
    w = Window.partitionBy(entity).orderBy(date)
    line = prices.select(entity, date, F.lead(date).over(w).alias("entry_date"), F.lead(price).over(w).alias("entry"), F.lead(date, hold + 1).over(w).alias("exit_date"), F.lead(price, hold + 1).over(w).alias("exit"))
    opening = prices.withColumn("_k", F.row_number().over(w)).withColumn("_d", F.lead(date, hold).over(w)).withColumn("_p", F.lead(price, hold).over(w)).filter("_k = 1")
    opening = opening.select(entity, F.lit("0001-01-01").cast("date").alias(date), F.col(date).alias("entry_date"), F.col(price).alias("entry"), F.col("_d").alias("exit_date"), F.col("_p").alias("exit"))
    known = line.unionByName(opening).withColumnRenamed(date, "_at")
    return asof(events, known, [entity], date, "_at", ["entry_date", "entry", "exit_date", "exit"])


def asof_scalar(asked: DataFrame, rows: DataFrame, at: str, date: str, values: list[str], most: int = ROWS) -> DataFrame:
    """asof() of dates against one series: the last row of `rows` at or before each."""
    return asof(asked, rows.select(*dict.fromkeys([date, *values])), [], at, date, values, most)


def with_dimension(df: DataFrame, dim: DataFrame, key: list[str], default: dict[str, str] | None = None) -> DataFrame:
    """df with the columns of a dimension that has one row a key; rows without one stay, with NULL or the given default."""
    out = df.join(dim, key, "left")
    return out.na.fill(default) if default else out
