"""Percentiles, ranking gains and tolerant parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Words that stand for true, false and no value in traces, in any case; and those that stand for no number.
TRUE = ("1", "true", "yes", "y", "on")
FALSE = ("0", "false", "no", "n", "off", "-1")
NO_BOOL = ("", "null", "none", "nan")
NO_NUMBER = ("", "-1", "null", "None", "nan")


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def interpolated(value: str, p: float) -> Column:
    """Linear interpolation at (n - 1) p."""
    return F.expr(f"percentile({value}, {p})")


def gain(label: Column, rank: Column) -> Column:
    """Discounted gain of a label at rank 1, 2, ..."""
    return (F.pow(F.lit(2.0), label) - 1) / F.log2(rank + 1)


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of these columns that exists, as a trimmed string; null without one."""
    there = next((F.trim(F.col(f"`{n}`").cast("string")) for n in names if n in df.columns), None)
    return F.lit(None).cast("string") if there is None else there


def missing(df: DataFrame, aliases: dict[str, Sequence[str]]) -> list[str]:
    """Wanted columns of which no alias exists."""
    return [k for k, names in aliases.items() if not any(n in df.columns for n in names)]


def as_bool(c: Column) -> Column:
    """True, false, or null for anything that is neither."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False)


def as_double(c: Column) -> Column:
    """A finite number, or null; -1 stands for a missing one."""
    x = F.trim(c.cast("string"))
    n = x.try_cast("double")
    return F.when(~x.isin(*NO_NUMBER) & ~F.isnan(n) & (F.abs(n) != float("inf")), n)


def as_long(c: Column) -> Column:
    """The whole part of a finite number, or null; long integers keep all their digits."""
    x = F.trim(c.cast("string"))
    n = as_double(c)
    cut = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    return F.when(~x.isin(*NO_NUMBER), F.coalesce(x.try_cast("long"), cut.cast("long")))
