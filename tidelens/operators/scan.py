"""Exponential smoothing over time as an associative scan: a long series is many tasks' work, in JVM expressions only.

A series is cut into slices of time. A slice needs to know of what lies before it only the last average and its weight, and what it does to these is one
affine map: so each slice is first summed up alone, the summaries of a series (few) are folded in order of time, and then each slice fills its own rows from
the state at its beginning. A series of one slice is filled at once.

Across a gap the older weight decays further, and the gap itself shows the last average; the seed is the first known value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.windows import catalogue, frame, ratio, series

#: Rows that a slice of a series should have: some 30 MB in a task.
ROWS = 1 << 18
#: Where a plan reads no more than so many bytes a row of a slice, its series aren't counted: none is taken to be longer.
ROW_BYTES = 64
#: Rows that are appended to one array before it is put aside: appending copies.
STRIDE = 64

_STATE = "struct<y: double, w: double>"


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _state(y: Column, w: Column) -> Column:
    return F.struct(y.cast("double").alias("y"), w.cast("double").alias("w"))


def _mixed(w: Column, old: Column, alpha: float, new: Column) -> Column:
    return (w * old + alpha * new) / (w + alpha)


def _step(alpha: float):
    """The state after one more value, known or not."""

    def step(s: Column, x: Column) -> Column:
        w = s["w"] * (1 - alpha)
        y = F.when(x.isNull(), s["y"]).when(s["y"].isNull(), x).otherwise(_mixed(w, s["y"], alpha, x))
        return _state(y, F.when(x.isNull(), w).otherwise(1.0))

    return step


def _summary(values: Column, alpha: float) -> Column:
    """What a slice does: the rows before its first value, that value, the affine map (a, b) from the average there to the last one, and the last weight."""

    def step(s: Column, x: Column) -> Column:
        w = s["w"] * (1 - alpha)
        none, new = x.isNull(), s["first"].isNull()
        return F.struct(
            F.when(none & new, s["lead"] + 1).otherwise(s["lead"]).alias("lead"),
            F.when(new, x).otherwise(s["first"]).alias("first"),
            F.when(none | new, s["a"]).otherwise(s["a"] * w / (w + alpha)).alias("a"),
            F.when(none | new, s["b"]).otherwise(_mixed(w, s["b"], alpha, x)).alias("b"),
            F.when(none & ~new, w).otherwise(1.0).alias("w"),
        )

    start = F.struct(F.lit(0.0).alias("lead"), F.lit(None).cast("double").alias("first"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("w"))
    return F.aggregate(values, start, step)


def _after(alpha: float):
    """The state after a slice of which the summary is known."""

    def step(s: Column, m: Column) -> Column:
        decayed = s["w"] * F.pow(F.lit(1 - alpha), m["lead"])
        first = F.when(s["y"].isNull(), m["first"]).otherwise(_mixed(decayed * (1 - alpha), s["y"], alpha, m["first"]))
        none = m["first"].isNull()
        return _state(F.when(none, s["y"]).otherwise(m["a"] * first + m["b"]), F.when(none, decayed).otherwise(m["w"]))

    return step


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _filled(values: Column, start: Column, alpha: float) -> Column:
    """The average at every row of a slice."""
    step = _step(alpha)

    def put(acc: Column, new: Column) -> Column:
        return F.struct(new.alias("s"), F.array_append(acc["out"], new["y"]).alias("out"))

    def strides(v: Column) -> Column:
        def stride(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["s"].alias("s"), _empty("double").alias("out"))
            own = F.aggregate(F.slice(v, i * STRIDE + 1, STRIDE), begin, lambda a, x: _let(step(a["s"], x), lambda new: put(a, new)))
            return _let(own, lambda o: F.struct(o["s"].alias("s"), F.array_append(acc["out"], o["out"]).alias("out")))

        begin = F.struct(start.alias("s"), _empty("array<double>").alias("out"))
        every = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int"))
        return F.flatten(F.aggregate(every, begin, stride)["out"])

    return _let(values, strides)


def slices(df: DataFrame, entity: str = "ticker", date: str = "date", rows: int = ROWS) -> DataFrame | None:
    """entity, low, span and pieces of the series that are more than one slice; None if there is none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= ROW_BYTES * rows:
        return None
    at = F.unix_micros(F.col(date).cast("timestamp"))
    spans = df.groupBy(entity).agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).filter(F.col("_n") > rows)
    long = spans.select(F.col(entity), F.col("_low"), (F.col("_high") - F.col("_low") + 1).cast("double").alias("_span"), F.ceil(F.col("_n") / rows).alias("_pieces"))
    return None if long.isEmpty() else long


def smooth(df: DataFrame, values: dict[str, tuple[str, float]], entity: str = "ticker", date: str = "date", rows: int = ROWS, gaps: dict[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """df with exponential averages without bias correction: {new column: (column, weight of a new value)}.

    gaps: averages of what one new column exceeds another by: {new column: (one, other, weight)}; long series take a second pass for them.
    """
    gaps = gaps or {}
    columns = df.columns
    sources = {c: f"_v{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in values.values()))}
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    own = df.select(F.col(entity).alias("_e"), F.col(date).alias("_t"), F.struct(*[known(c).alias(v) for c, v in sources.items()]).alias("_x"), F.struct(*columns).alias("_row"))
    long = slices(df, entity, date, rows)
    if long is None:
        own = own.withColumn("_slice", F.lit(0).cast("long"))
    else:
        own = own.join(long.withColumnRenamed(entity, "_e"), "_e", "left")
        place = F.floor((F.unix_micros(F.col("_t").cast("timestamp")) - F.col("_low")) / F.col("_span") * F.col("_pieces"))
        own = own.withColumn("_slice", F.coalesce(place, F.lit(0).cast("long"))).drop("_low", "_span", "_pieces")
    # Few bytes and much work a row: as many tasks as the session has for a shuffle, which Spark would merge by their bytes.
    own = own.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e", "_slice")
    sliced = own.groupBy("_e", "_slice").agg(F.sort_array(F.collect_list(F.struct("_t", "_x", "_row"))).alias("_rows"))
    series = lambda c: F.transform("_rows", lambda r: r["_x"][sources[c]])
    start = _state(F.lit(None), F.lit(1.0))
    if long is None:
        carried = sliced.select("*", *[start.alias(f"_s{i}") for i in range(len(values))])
    else:
        sums = sliced.select("_e", F.struct("_slice", *[_summary(series(c), a).alias(f"_m{i}") for i, (c, a) in enumerate(values.values())]).alias("_m"))
        folded = sums.groupBy("_e").agg(F.sort_array(F.collect_list("_m")).alias("_ms"))
        states = [_starts(f"_m{i}", a, start).alias(f"_s{i}") for i, (_, a) in enumerate(values.values())]
        zipped = folded.select("_e", F.transform("_ms", lambda m: m["_slice"]).alias("_slice"), *states)
        before = zipped.select("_e", F.explode(F.arrays_zip("_slice", *[f"_s{i}" for i in range(len(values))])).alias("_z")).select("_e", "_z.*")
        carried = sliced.join(before, ["_e", "_slice"])
    found = [_filled(series(c), F.col(f"_s{i}"), a).alias(f"_y{i}") for i, (c, a) in enumerate(values.values())]
    rows_ = carried.select(F.transform("_rows", lambda r: r["_row"]).alias("_row"), *found)
    names = {name: f"_y{i}" for i, name in enumerate(values)}
    if long is None:
        for name, (one, other, alpha) in gaps.items():
            over = F.zip_with(names[one], names[other], lambda a, b: a - b)
            names[name] = f"_y{len(names)}"
            rows_ = rows_.withColumn(names[name], _filled(over, start, alpha))
    out = rows_.select(F.explode(F.arrays_zip("_row", *names.values())).alias("_z"))
    out = out.select("_z._row.*", *[F.col(f"_z.{y}").alias(name) for name, y in names.items()])
    if long is None or not gaps:
        return out
    out = out.withColumns({f"_over_{name}": F.col(one) - F.col(other) for name, (one, other, _) in gaps.items()})
    return smooth(out, {name: (f"_over_{name}", alpha) for name, (_, _, alpha) in gaps.items()}, entity, date, rows).drop(*[f"_over_{name}" for name in gaps])


def _starts(name: str, alpha: float, start: Column) -> Column:
    """The states at the beginning of each slice of a series, from the slices' summaries in order."""
    after = _after(alpha)

    def put(acc: Column, m: Column) -> Column:
        return F.struct(after(acc["s"], m[name]).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out"))

    begin = F.struct(start.alias("s"), _empty(_STATE).alias("out"))
    return F.aggregate("_ms", begin, put)["out"]


def ewm(df: DataFrame, values: dict[str, tuple[str, int]], entity: str = "ticker", date: str = "date", gaps: dict[str, tuple[str, str, int]] | None = None) -> DataFrame:
    """Averages by span: {new column: (column, span)}, and of one's excess over another: {new column: (one, other, span)}."""
    over = {name: (one, other, 2 / (span + 1)) for name, (one, other, span) in (gaps or {}).items()}
    return smooth(df, {name: (c, 2 / (span + 1)) for name, (c, span) in values.items()}, entity, date, gaps=over)


def wilder(df: DataFrame, values: dict[str, tuple[str, int]], entity: str = "ticker", date: str = "date") -> DataFrame:
    """Averages as Wilder takes them: {new column: (column, rows)}, a new value weighs 1 / rows."""
    return smooth(df, {name: (c, 1 / n) for name, (c, n) in values.items()}, entity, date)


def indicators(df: DataFrame, entity: str = "ticker", date: str = "date") -> tuple[DataFrame, dict[str, Column]]:
    """df (close, high, low, volume) with what its indicators need, and all indicators by name: frames over rows, and averages that recur over time.

    Averages of MACD and close go by span; those of RSI and of the true range are Wilder's, over 14 rows.
    """
    w = series(entity, date)
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    before, step = F.lag("close").over(w), F.col("close") - F.lag("close").over(w)
    d = df.withColumn("_price", price).withColumns({
        "_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
        "_down": F.when(step.isNotNull(), -F.least(step, F.lit(0.0))),
        "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "_move": F.col("_price") - F.lag("_price").over(w),
    })
    money = F.col("_price") * F.col("volume")
    d = d.withColumns({"_in": F.when(F.col("_move").isNotNull(), F.when(F.col("_move") > 0, money).otherwise(0.0)), "_out": F.when(F.col("_move").isNotNull(), F.when(F.col("_move") < 0, money).otherwise(0.0))})
    spans = {"_ten": ("close", 2 / 11), "_fast": ("close", 2 / 13), "_slow": ("close", 2 / 27), "_gain": ("_up", 1 / 14), "_loss": ("_down", 1 / 14), "_atr": ("_range", 1 / 14)}
    d = smooth(d, spans, entity, date, gaps={"_signal": ("_fast", "_slow", 2 / 10)}).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    came, went = frame(F.sum, "_in", w, 14), frame(F.sum, "_out", w, 14)
    return d, {
        **catalogue(w), "close_10_ema": F.col("_ten"), "macd": F.col("_macd"), "macds": F.col("_signal"), "macdh": F.col("_macd") - F.col("_signal"), "atr": F.col("_atr"),
        "rsi": F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("_gain", "_loss"))), "mfi": 100 * ratio(came, came + went),
    }
