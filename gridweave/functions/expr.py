"""Small column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def above(x: Column, floor: float | Column) -> Column:
    """Maximum of x and floor that stays null for null x (``greatest`` skips nulls)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor) if not isinstance(floor, Column) else floor))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """x limited to [lo, hi]; the upper bound wins when the bounds cross. Null bounds do not limit."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def wave(x: Column, period: float, kind: str = "sin") -> Column:
    """Position on a cycle of the given period."""
    return getattr(F, kind)(F.lit(2 * math.pi) * x / F.lit(float(period)))


def hour_in(first: int, last: int) -> Column:
    return F.col("hour").between(first, last)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every double column."""
    return df.withColumns(
        {f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    )


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - 32) * 5 / 9


def mph_to_kmh(x: Column) -> Column:
    return x * 1.60934


def ms_to_kmh(x: Column) -> Column:
    return x * 3.6


def leading_number(text: Column) -> Column:
    """First token of a text such as '10 mph' as a number; null when it is none."""
    return F.element_at(F.split(F.trim(text), r"\s+"), 1).try_cast("double")
