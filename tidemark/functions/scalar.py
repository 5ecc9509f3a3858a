"""Scalar expressions shared by the detectors."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

NS = 1_000_000_000


def to_price(value: Column) -> Column:
    """Ten-thousandths, cut off toward zero."""
    return F.when(value < 0, F.ceil(value * 10000)).otherwise(F.floor(value * 10000)).cast("long")


def from_price(price_e4: Column) -> Column:
    return price_e4 / F.lit(10000.0)


def mid(bid: str = "bid_e4", ask: str = "ask_e4") -> Column:
    return F.expr(f"({bid} + {ask}) div 2")


def signed_change(side: Column, to: Column, base: Column) -> Column:
    """(to - base) / base for buyers, its negative for all others; null where base is 0."""
    change = F.try_divide((to - base).cast("double"), base)
    return F.when(side == "BUY", change).otherwise(-change)


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_binary(x: Column, digits: int) -> Column:
    """Rounded as DuckDB does: the product with the power of ten to the nearest integer, halves away from 0. (F.round takes
    the decimals a double is printed with, so the two differ where the product of an exact half falls short of it.)"""
    power = 10.0**digits
    return F.round(x * power) / power


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def softmax(values: Column) -> Column:
    """Of an array of doubles."""
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def exponential_kernel(beta: float, age_s: Column) -> Column:
    return beta * F.exp(-beta * age_s)


def power_kernel(age_s: Column, exponent: float = 1.1) -> Column:
    return F.pow(1 + age_s, F.lit(-exponent))


def poisson_pmf(k: Column, rate: float) -> Column:
    """Poisson mass of a count up to 20, by logarithms."""
    return F.exp(k * F.ln(F.lit(rate)) - rate) / F.factorial(k)


def day_second(ts_ns: Column) -> Column:
    return (ts_ns / NS).cast("long") % 86400


def price_bucket(price: Column, reference: Column, cells: int = 100, width: float = 0.0001) -> Column:
    """Cell of a relative price: truncated toward zero, the middle at cells/2, clamped to the ends; the middle for a
    reference of 0."""
    offset = F.coalesce((F.try_divide((price - reference).cast("double"), reference) / width).cast("long"), F.lit(0))
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), offset + cells // 2)).cast("long")


def rows_back(n: int, *by: str, order: tuple[str, ...]) -> WindowSpec:
    """The row and the n - 1 before it."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)


def span_back(width: int, *by: str, order: str = "ts_ns") -> WindowSpec:
    """All rows at most `width` older, the row's own time included."""
    return Window.partitionBy(*by).orderBy(order).rangeBetween(-width, 0)


def earlier(*by: str, order: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def up_to_now(*by: str, order: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def spread_pop(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from running sums."""
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
