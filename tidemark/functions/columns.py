"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public holidays counted by the feature table.
HOLIDAYS = [
    "2023-01-01", "2023-01-16", "2023-02-20", "2023-05-29", "2023-06-19", "2023-07-04", "2023-09-04",
    "2023-10-09", "2023-11-11", "2023-11-23", "2023-12-25", "2024-01-01", "2024-01-15", "2024-02-19",
    "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28",
    "2024-12-25",
]

# Zone id ranges (inclusive) and their borough.
BOROUGHS = [
    (1, 10, "Staten Island"),
    (11, 50, "Brooklyn"),
    (51, 150, "Queens"),
    (151, 220, "Manhattan"),
    (221, 265, "Bronx"),
]

# Zones with an airport.
AIRPORT_ZONES = [1, 132, 138]


def safe_ratio(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """numerator / denominator where the denominator is positive, else ``otherwise``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def banded(value: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first band whose upper bound lies above ``value``."""
    out = F.when(value < bands[0][0], bands[0][1])
    for bound, label in bands[1:]:
        out = out.when(value < bound, label)
    return out.otherwise(rest)


def time_of_day(hour: Column) -> Column:
    return banded(hour, [(6, "night"), (12, "morning"), (18, "afternoon")], "evening")


def time_of_day_evening_to_22(hour: Column) -> Column:
    """The second definition in use: 6-11 morning, 12-17 afternoon, 18-21 evening, else night."""
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night")
    )


def is_rush_hour(hour: Column) -> Column:
    return flag(hour.between(7, 9) | hour.between(17, 19))


def is_weekend(day_of_week: Column) -> Column:
    return flag(day_of_week.isin(1, 7))


def is_holiday(day: Column, holidays: Sequence[str] = HOLIDAYS) -> Column:
    return flag(day.isin([F.to_date(F.lit(h)) for h in holidays]))


def borough(zone: Column) -> Column:
    out = None
    for low, high, name in BOROUGHS:
        hit = zone.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def is_airport(zone: Column) -> Column:
    return flag(zone.isin(AIRPORT_ZONES))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def salt(buckets: int, *row_key: str) -> Column:
    """A salt that repeats between runs: it depends on the row's own key only."""
    return F.pmod(F.xxhash64(*row_key), F.lit(buckets)).cast("int")


# Byte units of memory settings.
MEMORY_UNITS = {"Ki": 1024, "Mi": 1048576, "Gi": 1073741824, "Ti": 1099511627776}



def number(text: Column) -> Column:
    """A plain number as double, else NULL. The pattern is tested first: a failing try_cast is slow."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def memory_bytes(text: Column) -> Column:
    """Bytes of '4Gi', '512Mi' or a plain number; anything else is 0."""
    units = F.create_map(*[F.lit(x) for unit, size in MEMORY_UNITS.items() for x in (unit, float(size))])
    text = F.trim(text)
    factor = F.try_element_at(units, F.right(text, F.lit(2)))
    digits = F.when(factor.isNull(), text).otherwise(F.left(text, F.length(text) - 2))
    return F.coalesce(F.floor(number(digits) * F.coalesce(factor, F.lit(1.0))), F.lit(0))
