"""Cells of a month's sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_cells(months: DataFrame) -> DataFrame:
    """month, cell, day, in_month: whole weeks from Monday on that cover each of ``months`` (month, any day of it)."""
    first = F.trunc("month", "month")
    before = F.weekday(first)
    days = F.ceil((before + F.day(F.last_day(first))) / 7).cast("int") * 7
    cells = months.select(first.alias("month")).distinct().select("month", F.posexplode(F.sequence(F.date_sub("month", F.weekday("month")), F.date_add(F.date_sub("month", before), days - 1))).alias("cell", "day"))
    return cells.select("month", F.col("cell").cast("long").alias("cell"), "day", (F.trunc("day", "month") == F.col("month")).alias("in_month"))
