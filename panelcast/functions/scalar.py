"""Scalar column expressions. Everything stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the heat index regression in degrees Fahrenheit, as
# (coefficient, power of temperature, power of relative humidity).
HEAT_INDEX_TERMS = [
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
]

# Season of each month in the southern hemisphere.
SEASONS = {
    "summer": [12, 1, 2],
    "autumn": [3, 4, 5],
    "winter": [6, 7, 8],
    "spring": [9, 10, 11],
}

# Months of the main transmission season.
PEAK_MONTHS = [1, 2, 3, 4, 5]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def at_least(x: Column, floor: float = 0.0) -> Column:
    """Raise values below ``floor``; NULL stays NULL."""
    return F.when(x < F.lit(floor), F.lit(floor)).otherwise(x)


def season(month: Column) -> Column:
    out = None
    for name, months in SEASONS.items():
        out = F.when(month.isin(months), name) if out is None else out.when(month.isin(months), name)
    return out


def cycle(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of ``x`` on a circle of the given period."""
    angle = F.lit(2.0) * F.pi() * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def heat_index(celsius: Column, humidity: Column) -> Column:
    """Apparent temperature in Celsius from temperature and relative humidity."""
    t = celsius.cast("double") * 9.0 / 5.0 + 32.0
    r = humidity.cast("double")

    def term(coefficient: float, i: int, j: int) -> Column:
        factors = [F.lit(coefficient)] + [t] * i + [r] * j
        return reduce(lambda a, b: a * b, factors)

    fahrenheit = reduce(lambda a, b: a + b, [term(*x) for x in HEAT_INDEX_TERMS])
    return (fahrenheit - 32.0) * 5.0 / 9.0


def week_of_epiweek(epiweek: Column) -> Column:
    return epiweek % 100


def next_sunday(date: Column) -> Column:
    """The date itself if it is a Sunday, else the following one."""
    return F.next_day(F.date_sub(date, 1), "Sun")


def week_start(ts: Column) -> Column:
    """Sunday on or before the given time."""
    d = ts.cast("date")
    return F.date_sub(d, F.dayofweek(d) - 1)
