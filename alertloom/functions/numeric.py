"""Numeric cleaning, ratios and budgets."""

from pyspark.sql import Column, functions as F


def clean_number(c: Column) -> Column:
    """float32 with text, infinities and missing values turned into 0."""
    x = c.try_cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(usable, x).otherwise(F.lit(0.0)).cast("float")


def shrink_integer(c: Column) -> Column:
    return c.try_cast("int")


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic_mean(p: Column, r: Column) -> Column:
    return guarded_ratio(F.lit(2.0) * p * r, p + r)


def pair_count(n: Column) -> Column:
    """n over 2 as decimal(38,0): group sizes beyond 4e9 would overflow a bigint."""
    d = n.cast("decimal(18,0)")
    return (d * (d - F.lit(1)) / F.lit(2)).cast("decimal(38,0)")


def benign_budget(n_attack: Column, n_available: Column, multiplier: int, floor: int, cap: int) -> Column:
    wanted = F.greatest(F.lit(floor), n_attack * F.lit(multiplier))
    return F.least(F.lit(cap), wanted, n_available).cast("long")


def share_budget(n_available: Column, n_total: Column, target: int, floor: int) -> Column:
    share = n_available.cast("double") / n_total.cast("double")
    wanted = F.greatest(F.lit(floor), F.floor(F.lit(target) * share))
    return F.least(wanted, n_available).cast("long")
