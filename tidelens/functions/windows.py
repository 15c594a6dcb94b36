"""Per-entity time-series expressions.

All of them count rows, not calendar days; a frame gives NULL until it holds `least` values. Divisions by zero give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(entity: str | list[str] = "ticker", date: str = "date") -> WindowSpec:
    """The rows of one entity by date."""
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(date)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation of the pairs that are both known; NULL where one of them doesn't vary."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def frame(agg, x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg(x) over the last n rows, if at least `least` (n by default) of them hold a value."""
    rows = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(rows) >= (n if least is None else least), agg(col(x)).over(rows))


def ahead(agg, x: str | Column, w: WindowSpec, first: int, last: int) -> Column:
    """agg(x) over the rows first..last from now, if all of them hold a value."""
    rows = w.rowsBetween(first, last)
    return F.when(F.count(col(x)).over(rows) == last - first + 1, agg(col(x)).over(rows))


def filled(x: str | Column, w: WindowSpec) -> Column:
    """The last known value."""
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def momentum(x: str | Column, w: WindowSpec, n: int, skip: int = 0) -> Column:
    """x of `skip` rows ago over x of n rows ago, less 1."""
    now = F.lag(col(x), skip).over(w) if skip else col(x)
    return ratio(now, F.lag(col(x), n).over(w)) - 1


def change(x: str | Column, w: WindowSpec, n: int = 1, fill: bool = True) -> Column:
    """Change over n rows; with fill a gap is taken for the last known value first. Only for a plain column when filling."""
    if not fill:
        return momentum(x, w, n)
    steps = w.rowsBetween(Window.unboundedPreceding, -n)
    return ratio(filled(x, w), F.last(col(x), ignorenulls=True).over(steps)) - 1


def forward(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    """x of n rows from now over x, less 1."""
    return ratio(F.lead(col(x), n).over(w), x) - 1


def volatility(r: str | Column, w: WindowSpec, n: int, least: int | None = None, year: float | None = 252) -> Column:
    """Sample deviation of returns; annualised if a year's number of rows is given."""
    if least is None:
        least = n // 2 if n > 20 else int(0.8 * n)
    found = frame(F.stddev_samp, r, w, n, least)
    return found * F.sqrt(F.lit(float(year))) if year else found


def bias(x: str | Column, w: WindowSpec, n: int) -> Column:
    return ratio(x, frame(F.avg, x, w, n, n // 2)) - 1


def rsi(step: str | Column, w: WindowSpec, n: int) -> Column:
    """Relative strength from means of gains and losses; without a loss it is 100. step: the row's change in price."""
    known = col(step).isNotNull()
    gain = frame(F.avg, F.when(known, F.greatest(col(step), F.lit(0.0))), w, n, n // 2)
    loss = frame(F.avg, F.when(known, -F.least(col(step), F.lit(0.0))), w, n, n // 2)
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def bollinger(x: str | Column, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column]:
    """Width of the band over its middle, and where x stands in the band."""
    middle, deviation = frame(F.avg, x, w, n, n // 2), frame(F.stddev_samp, x, w, n, n // 2)
    return ratio(2 * k * deviation, middle), ratio(col(x) - (middle - k * deviation), 2 * k * deviation)


def nav(r: str | Column, w: WindowSpec) -> Column:
    """Compounded growth of 1. A product, not a sum of logarithms: after -100 % it stays at 0."""
    return F.product(1 + col(r)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(level: str | Column, w: WindowSpec) -> Column:
    """The level's distance from its running maximum, 0 or less."""
    top = F.max(col(level)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ratio(col(level) - top, top)


def trailing_volatility(r: str | Column, w: WindowSpec, n: int = 60) -> Column:
    """Sample deviation of the last n returns up to a row, 0 if there are fewer than two."""
    return F.coalesce(frame(F.stddev_samp, r, w, n, 2), F.lit(0.0))


def catalogue(w: WindowSpec, close: str = "close", high: str = "high", low: str = "low", volume: str = "volume") -> dict[str, Column]:
    """Indicators by name that are frames over rows; those that recur over time are in operators.scan.indicators()."""
    middle, spread = frame(F.avg, close, w, 20), frame(F.stddev_samp, close, w, 20)
    traded = frame(F.sum, col(close) * col(volume), w, 14)
    return {
        "close_50_sma": frame(F.avg, close, w, 50), "close_200_sma": frame(F.avg, close, w, 200), "boll": middle, "boll_ub": middle + 2 * spread, "boll_lb": middle - 2 * spread,
        "vwma": ratio(traded, frame(F.sum, volume, w, 14)), "close": col(close), "high": col(high), "low": col(low), "volume": col(volume),
    }
