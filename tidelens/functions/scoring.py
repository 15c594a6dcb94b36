"""Rule-based scores, position sizes and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelens.functions.windows import col

# The sweet spots, worst values, weights, thresholds and multipliers of the scores and positions in this file, which
# decisions must agree on: 12/45, 1.5/5, 0.5/3, 1.8/0.5, 0.2/0, 0.15/0, 2/200, 0.3/-0.2 and 0.8/2 for the figures; 0.25, 0.35, 0.20, 0.10, 0.10 for the
# O-score; z of 0.5, 1, 1.5 and 2; doubt of 0.03, 0.05 and 0.06; debt over 3 with less than 0.8 at hand.

#: Score for a figure that isn't known.
MIDDLING = 50.0


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def smaller_is_better(x: str | Column, sweet: float, worst: float) -> Column:
    """100 up to the sweet spot, then decaying so that exp(-1.5) of it is left at `worst`."""
    x = col(x)
    decayed = _within(100.0 * F.exp(F.lit(-1.5 / (worst - sweet)) * (x - sweet)))
    return F.when(x.isNull() | F.isnan(x), MIDDLING).when(x <= sweet, 100.0).otherwise(decayed)


def larger_is_better(x: str | Column, sweet: float, worst: float) -> Column:
    """0 up to `worst`, 100 from the sweet spot, a line between."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x), MIDDLING).otherwise(_within((x - worst) / (sweet - worst) * 100.0))


def value_score(pe: str | Column, pb: str | Column) -> Column:
    """Cheapness; a loss (pe of 0 or less) scores 0 and an unknown ratio like a dear one."""
    pe, pb = col(pe), col(pb)
    by_pe = F.when(pe <= 0, 0.0).otherwise(smaller_is_better(F.coalesce(pe, F.lit(100.0)), 12, 45))
    by_pb = smaller_is_better(F.when(pb > 0, pb).otherwise(10.0), 1.5, 5.0)
    return 0.7 * by_pe + 0.3 * by_pb


def quality_score(current: str | Column, debt: str | Column, margin: str | Column, roe: str | Column) -> Column:
    """Liquidity, little debt, margin and return on equity. An unknown debt counts as none."""
    debt = col(debt)
    owed = smaller_is_better(F.when(debt >= 0, debt).otherwise(0.0), 0.5, 3.0)
    return 0.2 * larger_is_better(current, 1.8, 0.5) + 0.3 * owed + 0.25 * larger_is_better(margin, 0.2, 0.0) + 0.25 * larger_is_better(roe, 0.15, 0.0)


def size_score(cap: str | Column) -> Column:
    return smaller_is_better(col(cap) / 1e9, 2.0, 200.0)


def momentum_score(ret: str | Column) -> Column:
    return larger_is_better(ret, 0.3, -0.2)


def volatility_score(beta: str | Column) -> Column:
    beta = col(beta)
    return F.when(beta < 0, MIDDLING).otherwise(smaller_is_better(beta, 0.8, 2.0))


def overall_score(value: Column, quality: Column, momentum: Column, size: Column, volatility: Column) -> Column:
    """The weighted scores, each rounded to two digits first (half to even)."""
    r = lambda x: F.bround(x, 2)
    return r(0.25 * r(value) + 0.35 * r(quality) + 0.20 * r(momentum) + 0.10 * r(size) + 0.10 * r(volatility))


def z_score(mean: str | Column, deviation: str | Column) -> Column:
    """Mean over deviation, which counts as .005 at least."""
    return col(mean) / F.greatest(col(deviation), F.lit(0.005))


def z_decision(z: str | Column) -> Column:
    z = col(z)
    return F.when(z >= 0.5, "BUY").when(z <= -0.5, "SELL").otherwise("HOLD")


def signal_regime(z: str | Column, doubt: str | Column) -> Column:
    z, doubt = col(z), col(doubt)
    return F.when((F.abs(z) > 2.0) & (doubt < 0.05), F.when(z > 0, "STRONG_TREND_UP").otherwise("STRONG_TREND_DOWN")).when(doubt > 0.06, "HIGH_VOL").otherwise("RANGING_MIXED")


def position(z: str | Column, doubt: str | Column, sentiment: str | Column, risk: str | Column, overall: str | Column) -> Column:
    """Share of a full position, before the bust rule."""
    z, doubt, regime = col(z), col(doubt), signal_regime(z, doubt)
    cap = F.tanh(F.abs(z)) * F.exp(-10.0 * F.greatest(F.lit(0.0), doubt - 0.03))
    cap = cap * F.when(regime == "HIGH_VOL", 0.3).when(regime == "RANGING_MIXED", 0.7).otherwise(1.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cap * (1 + 0.3 * col(sentiment)) * (1 - col(risk))))
    return F.least(F.lit(1.0), share * (0.5 + col(overall) / 100.0))


def is_bust(debt: str | Column, current: str | Column) -> Column:
    """Deep in debt without cash at hand; unknown debt is none, an unknown ratio is 1."""
    return (F.coalesce(col(debt), F.lit(0.0)) > 3.0) & (F.coalesce(col(current), F.lit(1.0)) < 0.8)


def confidence(z: str | Column) -> tuple[Column, Column]:
    """Decision and confidence by how far z is from 0: levels at .5, 1 and 1.5."""
    z = col(z)
    a = F.abs(z)
    side = F.when(z > 0, "BULLISH").otherwise("BEARISH")
    decision = F.when(a < 0.5, "HOLD").otherwise(F.concat(F.when(a < 1.0, "SMALL ").when(a < 1.5, "MEDIUM ").otherwise("LARGE "), side, F.lit(" POSITION")))
    sure = F.when(a < 0.5, 0.85 - 0.2 * (a / 0.5)).when(a < 1.0, 0.6 + 0.1 * (a - 0.5) / 0.5).when(a < 1.5, 0.7 + 0.1 * (a - 1.0) / 0.5)
    return decision, sure.otherwise(F.least(0.8 + 0.15 * (a - 1.5), F.lit(0.95)))


def raw_weight(overall: str | Column, doubt: str | Column) -> Column:
    """Score over doubt, like risk parity; to be divided by its sum."""
    return F.greatest(F.lit(0.0), col(overall)) / (col(doubt) + 0.005)


def ratios() -> dict[str, Column]:
    """Fundamental ratios of net_income (of a quarter), revenue, assets, liabilities, equity, cash_flow, eps and price."""
    d = F.try_divide
    c = F.col
    return {
        "roe": d(c("net_income") * 4, c("equity")), "margin": d(c("net_income"), c("revenue")), "roa": d(c("net_income") * 4, c("assets")), "asset_turnover": d(c("revenue"), c("assets")),
        "debt_to_equity": d(c("liabilities"), c("equity")), "cash_to_liabilities": d(c("cash_flow"), c("liabilities")), "ep": d(c("eps"), c("price")), "sp": d(c("revenue"), c("price")), "bp": d(c("equity"), c("price")),
    }


def exchange_code(x: str | Column) -> Column:
    """sh.600519 as 600519.SS and sz.000001 as 000001.SZ; others stay."""
    x = col(x)
    return F.when(x.rlike(r"^sh\."), F.concat(F.substring(x, 4, 20), F.lit(".SS"))).when(x.rlike(r"^sz\."), F.concat(F.substring(x, 4, 20), F.lit(".SZ"))).otherwise(x)


def local_code(x: str | Column) -> Column:
    """600519.SS as sh.600519; others stay."""
    x = col(x)
    bare = F.regexp_replace(x, r"\.(SS|SZ)$", "")
    return F.when(x.endswith(".SS"), F.concat(F.lit("sh."), bare)).when(x.endswith(".SZ"), F.concat(F.lit("sz."), bare)).otherwise(x)


def fenced_json(text: str | Column, schema: str, defaults: dict[str, float]) -> Column:
    """The first fenced (or else bare) JSON object in a text, with defaults for what it lacks."""
    text = col(text)
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.from_json(F.when(inner != "", inner).otherwise(bare), schema)
    return F.struct(*[F.coalesce(found[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def sign_bits(values: str | Column) -> Column:
    """Signs of an array as one number, the first value as the lowest bit."""
    return F.aggregate(F.transform(col(values), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)


def sign_words(values: str | Column, width: int = 32) -> Column:
    """Signs of an array of any length as numbers of `width` bits each, in order."""
    x = col(values)
    starts = F.sequence(F.lit(0), F.ceil(F.size(x) / F.lit(width)).cast("int") - 1)
    return F.transform(starts, lambda k: sign_bits(F.slice(x, k * width + 1, F.lit(width))))


def bits_of(number: str | Column, width: int) -> Column:
    """The bits of a number as an array of 0 and 1, lowest first."""
    return F.array(*[F.shiftright(col(number), i).bitwiseAND(F.lit(1)).cast("int") for i in range(width)])


def mean_return(text: str | Column) -> Column:
    """The number after `mean_return=` in a text."""
    return F.regexp_extract(col(text), r"mean_return=\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def json_array(text: str | Column, schema: str) -> Column:
    """The array from the first [ to the last ] of a text; NULL if that isn't one."""
    return F.from_json(F.regexp_extract(col(text), r"(?s)(\[.*\])", 1), schema)
