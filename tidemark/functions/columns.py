"""Column building blocks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NOISE_FACTOR = 1.4826


def r6(c: Column | str) -> Column:
    """Rounded to six places; negative zero becomes zero."""
    return F.round(c, 6) + F.lit(0.0)


def ratio_pct(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole as a double, null where the whole is 0 or null."""
    return F.try_divide(F.lit(100.0) * F.col(part) if isinstance(part, str) else F.lit(100.0) * part, F.col(whole) if isinstance(whole, str) else whole)


def month_floor(c: Column | str) -> Column:
    return F.trunc(c, "MM").cast("date")


def month_number(c: Column | str) -> Column:
    """Months since year 0: differences of these are whole calendar months."""
    return F.year(c) * 12 + F.month(c)


def quantile(c: Column | str, q: float) -> Column:
    """Exact quantile, linear between neighbours; nulls don't count."""
    return F.percentile(c, F.lit(q))


def median(c: Column | str) -> Column:
    return quantile(c, 0.5)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation, null where either is constant (``corr`` raises there under ANSI rules)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def first_min(value: Column, at: Column) -> Column:
    """``at`` of the least value, the earliest on ties; null values don't count."""
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), at.alias("a"))))["a"]


def first_max(value: Column, at: Column) -> Column:
    return first_min(-value, at)


def mid_rank_pct(less: Column, equal: Column, n: Column) -> Column:
    """100 (less + equal / 2) / n, null without a reference."""
    return F.try_divide(F.lit(100.0) * (less + F.lit(0.5) * equal), n)


def runs(flag: Column, keys: list[str], order: str) -> Column:
    """An id for each unbroken run of rows with the same flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))


def cyclic_offset(c: Column) -> Column:
    """Month difference taken into (-6, 6]."""
    return F.pmod(c + 5, F.lit(12)) - 5
