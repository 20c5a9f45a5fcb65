"""Dates in Turkish as columns, whatever the session's locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of months and, from Monday on, of weekdays.
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
WEEKDAYS = ("Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar")


def _named(names: tuple[str, ...], nth: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), nth)


def _month(day: Column) -> Column:
    return F.concat(_named(MONTHS, F.month(day)), F.lit(" "), F.year(day).cast("string"))


def long_date(day: Column) -> Column:
    """A day with its month, year and weekday."""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), _month(day), F.lit(", "), _named(WEEKDAYS, F.weekday(day) + 1))


def date_range(starts: Column, ends: Column) -> Column:
    """Two days, with the month once where they share it."""
    first, last = F.dayofmonth(starts).cast("string"), F.dayofmonth(ends).cast("string")
    within = (F.month(starts) == F.month(ends)) & (F.year(starts) == F.year(ends))
    across = F.concat(first, F.lit(" "), _named(MONTHS, F.month(starts)), F.lit(" - "), last, F.lit(" "), _month(ends))
    return F.when(within, F.concat(first, F.lit("-"), last, F.lit(" "), _month(starts))).otherwise(across)
