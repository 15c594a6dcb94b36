"""Ranks, bins and residuals within groups (a date, or a date and a sector)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidelens.functions.windows import col, ratio


def avg_rank(x: str | Column, *group: str) -> Column:
    """Rank from 1 with ties at their mean; NULL stays NULL. Ties are the row's own peers in the rank's order, so one shuffle and one sort serve both."""
    x = col(x)
    w = Window.partitionBy(*group).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    place = F.rank().over(w)
    return F.when(x.isNotNull(), place + (ties - 1) / 2.0)


def pct_rank(x: str | Column, *group: str) -> Column:
    """avg_rank over the number of values. Unlike percent_rank() it runs to 1 and doesn't count NULLs."""
    return avg_rank(x, *group) / F.count(col(x)).over(Window.partitionBy(*group))


def demean(x: str | Column, *group: str) -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*group))


def demean_exact(x: str | Column, *group: str, digits: int = 8, out: int = 6) -> Column:
    """demean() of values of up to `digits` decimals, rounded half up to `out`: in whole numbers, so that no order of adding changes a digit."""
    w, unit, step = Window.partitionBy(*group), 10.0**digits, 10 ** (digits - out)
    whole = F.round(col(x) * unit).cast("long")
    n, total = F.count(whole).over(w), F.sum(whole).over(w)
    return F.floor((2 * (whole * n - total) + step * n) / (2 * step * n)) / 10.0**out


def impute(x: str | Column, *group: str, default: float = 0.0) -> Column:
    """The group's median for a NULL, then a constant."""
    return F.coalesce(col(x), F.median(col(x)).over(Window.partitionBy(*group)), F.lit(default))


def qcut_edges(x: str | Column, bins: int, *group: str) -> Column:
    """Interpolated quantiles without repeats, at multiples of the rounded step 1 / bins as pandas takes them."""
    shares = F.array(*[F.lit(i * (1 / bins) if i < bins else 1.0) for i in range(bins + 1)])
    return F.array_distinct(F.percentile(col(x), shares).over(Window.partitionBy(*group)))


def bin_of(x: str | Column, edges: str | Column) -> Column:
    """Right-closed bin from 0; the lowest edge belongs to the first."""
    value = col(x)
    return F.when(value.isNotNull(), F.greatest(F.size(F.filter(col(edges), lambda e: e < value)) - 1, F.lit(0)))


def relevance(share: str | Column, steps: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> Column:
    """Right-closed grade 0, 1, .. of a percentile rank."""
    share, out = col(share), F.lit(len(steps))
    for i, edge in reversed(list(enumerate(steps))):
        out = F.when(share <= edge, i).otherwise(out)
    return F.when(share.isNotNull(), out)


def clip(x: str | Column, low: Column, high: Column) -> Column:
    """x between two bounds; a NULL bound doesn't bind and NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def residual(y: str | Column, x: str | Column, group: list[str], least: int, strict: bool = False, small: Column | None = None) -> Column:
    """What a regression y ~ 1 + x within the group leaves over, where both are known.

    Groups with fewer than `least` pairs (with strict: not more than that) give `small`, NULL by default.
    """
    y, x = col(y), col(x)
    both = y.isNotNull() & x.isNotNull()
    w = Window.partitionBy(*group)
    py, px = F.when(both, y), F.when(both, x)
    n = F.count(F.when(both, 1)).over(w)
    n_ok = n > least if strict else n >= least
    # Centred sums, so that nothing large cancels.
    mean_x, mean_y = F.avg(px).over(w), F.avg(py).over(w)
    slope = F.coalesce(ratio(F.covar_pop(py, px).over(w), F.var_pop(px).over(w)), F.lit(0.0))
    return F.when(n_ok, py - (mean_y + slope * (px - mean_x))).otherwise(small if small is not None else F.lit(None).cast("double"))


def first_k(order: list[Column], k: int | Column, *group: str) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= k


def top_count(n: Column, share: float) -> Column:
    """max(1, int(n * share))."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(share))).cast("int")
