"""Metric series in long form: trends, latest values, comparisons with last year, and collapsed repeats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scoring import percent_change


def _recent(kpis: DataFrame, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("as_of").desc(), F.col("id").desc())
    return kpis.withColumn("_nth", F.row_number().over(order))


def trends(kpis: DataFrame, points: int = 12) -> DataFrame:
    """The last ``points`` primary readings of each metric."""
    return _recent(kpis.filter("is_primary"), "metric_key").filter(F.col("_nth") <= points).drop("_nth")


def latest(kpis: DataFrame, *by: str) -> DataFrame:
    """The last reading of each metric (and further keys)."""
    return _recent(kpis, "metric_key", *by).filter("_nth = 1").drop("_nth")


def value_for_year(kpis: DataFrame, year: int) -> DataFrame:
    """The last reading of each metric in a year, by a half-open range that scans can prune by."""
    inside = (F.col("as_of") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("as_of") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))
    return latest(kpis.filter(inside))


def dashboard(kpis: DataFrame) -> DataFrame:
    """metric_key, value, previous, change: the last primary reading against the one before."""
    two = _recent(kpis.filter("is_primary"), "metric_key").filter(F.col("_nth") <= 2)
    of = lambda n, c: F.max(F.when(F.col("_nth") == n, F.col(c)))
    rows = two.groupBy("metric_key").agg(of(1, "as_of").alias("as_of"), of(1, "value").alias("value"), of(2, "value").alias("previous"))
    return rows.withColumn("change", percent_change(F.col("value"), F.col("previous")))


def axis(kpis: DataFrame) -> DataFrame:
    """metric_key, low, high: the range of a chart, widened only where all values are equal."""
    ends = kpis.groupBy("metric_key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    pad = F.when(F.col("low") == F.col("high"), F.when(F.col("low") == 0, F.lit(1.0)).otherwise(F.abs("low") * 0.05)).otherwise(0.0)
    return ends.select("metric_key", (F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))


def signed_percent(change: Column) -> Column:
    """A change in per cent with one decimal, with its sign unless it is zero."""
    return F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1f%%", change))


def against_last_year(kpis: DataFrame, year: int) -> DataFrame:
    """metric_key, value, ly_value, ly_change: the last reading against the last of ``year``."""
    before = value_for_year(kpis.filter("is_primary"), year).select(F.col("metric_key").alias("_key"), F.col("value").alias("ly_value"))
    now = latest(kpis.filter("is_primary")).select("metric_key", "value")
    return now.join(before, F.col("metric_key") == F.col("_key"), "left").select("metric_key", "value", "ly_value", percent_change(F.col("value"), F.col("ly_value")).alias("ly_change"))


def corroborations(kpis: DataFrame, metric: str, most: int = 5) -> DataFrame:
    """Of the last ``most`` secondary readings of a metric, the last of each source; so there may be fewer."""
    rows = kpis.filter((F.col("metric_key") == metric) & ~F.col("is_primary"))
    return latest(rows.orderBy(F.col("as_of").desc(), F.col("id").desc()).limit(most), "source")


def without_repeats(kpis: DataFrame, block: str = "month") -> DataFrame:
    """Of consecutive readings of equal value and source, the first.

    Readings are compared within blocks of time, so that a metric's history isn't one task; a block's first reading is
    compared with the last one before the block, of which there is one a block and metric.
    """
    kept = [c for c in kpis.columns]
    rows = kpis.withColumn("_block", F.date_trunc(block, "as_of"))
    order = Window.partitionBy("metric_key", "_block").orderBy("as_of", "id")
    pair = F.struct("value", "source")
    marked = rows.withColumns({"_before": F.lag(pair).over(order), "_nth": F.row_number().over(order)})
    ends = rows.groupBy(F.col("metric_key").alias("_key"), F.col("_block").alias("_of")).agg(F.max_by(pair, F.struct("as_of", "id")).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("_key").orderBy("_of")))
    joined = marked.join(ends, F.col("metric_key").eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    before = F.when(F.col("_nth") == 1, F.col("_end")).otherwise(F.col("_before"))
    return joined.filter(before.isNull() | ~before["value"].eqNullSafe(F.col("value")) | ~before["source"].eqNullSafe(F.col("source"))).select(*kept)


def changed(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming readings that differ from the last known one of their metric in value or source."""
    known = latest(existing).select(F.col("metric_key").alias("_key"), F.col("value").alias("_value"), F.col("source").alias("_source"))
    joined = incoming.join(known, F.col("metric_key") == F.col("_key"), "left")
    same = F.col("value").eqNullSafe(F.col("_value")) & F.col("source").eqNullSafe(F.col("_source"))
    return joined.filter(F.col("_key").isNull() | ~same).drop("_key", "_value", "_source")


def for_export(kpis: DataFrame, metric: str) -> DataFrame:
    """The columns of the CSV export, to be written in ascending order; a missing address is empty."""
    rows = kpis.filter((F.col("metric_key") == metric) & F.col("is_primary"))
    return rows.orderBy("as_of", "id").select(F.col("as_of").cast("date").alias("date"), "value", "unit", "source", F.coalesce("source_url", F.lit("")).alias("source_url"))


# Flights of a day for each one in the air, dollars between crude and jet fuel, the factor of its history, and the days of a period.
FLIGHTS_PER_AIRBORNE, CRACK_SPREAD, FUEL_FACTOR = 12, 57.0, 1.18
PERIOD_DAYS = {"1w": 7, "1m": 30, "3m": 90, "6m": 180, "1y": 365}


def _long(rows: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """keys, metric_key, value: a row for each metric that has a value."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric_key"), v.cast("double").alias("value")) for k, v in metrics.items()))
    return rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric_key", "m.value").filter("value is not null")


def published(years: DataFrame) -> DataFrame:
    """as_of, metric_key, value from published figures of a year.

    ``years``: as_of, passengers and departures in millions, load_factor in per cent, and rpk, passenger_revenue,
    cargo_revenue, ancillary_revenue and ebit in billions. Capacity, yield and unit revenue and cost follow from them.
    """
    c, bn = F.col, 1e9
    ask = c("rpk") / (c("load_factor") / 100)
    revenue = c("passenger_revenue") + c("cargo_revenue") + c("ancillary_revenue")
    return _long(years, ["as_of"], {
        "passengers_ytd": c("passengers") * 1e6, "load_factor": c("load_factor"), "rpk": c("rpk") * bn, "ask": F.round(ask) * bn, "departures": c("departures") * 1e6,
        "passenger_revenue_ytd": c("passenger_revenue") * bn, "ancillary_revenue_ytd": c("ancillary_revenue") * bn,
        "total_aviation_revenue_ytd": (c("passenger_revenue") + c("ancillary_revenue")) * bn, "yield_per_rpk": F.round(c("passenger_revenue") / c("rpk") * 100, 2),
        "rask": F.round(revenue / ask * 100, 2), "cask": F.round((revenue - c("ebit")) / ask * 100, 2),
    })


def live(readings: DataFrame) -> DataFrame:
    """as_of, metric_key, value from ``readings`` (as_of, airborne, brent, usd_try; null: not read), with what is derived from them."""
    c = F.col
    return _long(readings, ["as_of"], {"flights_airborne": c("airborne"), "flights_today": F.round(c("airborne") * FLIGHTS_PER_AIRBORNE), "oil_price": c("brent"), "fuel_price": F.round(c("brent") + CRACK_SPREAD, 2), "fx_usd_try": c("usd_try")})


def cross_check(value: Column, other: Column) -> Column:
    """By how many per cent another source differs; 0 where there is nothing to compare with."""
    return F.when(value != 0, F.round(F.abs(value - other) / value * 100, 3)).otherwise(0.0)


def last_year(history: DataFrame) -> DataFrame:
    """metric_key, value, is_primary: the first point of each metric's last year (metric_key, at, value), under a name of its own so that no trend shows it."""
    return history.groupBy("metric_key").agg(F.min_by("value", "at").alias("value")).select(F.concat("metric_key", F.lit("_ly")).alias("metric_key"), "value", F.lit(False).alias("is_primary"))


def history(kpis: DataFrame, metric: str, as_of: str, period: str) -> DataFrame:
    """as_of, value of a metric's primary readings of a period (1w, 1m, 3m, 6m or 1y), oldest first."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"unknown period {period!r}")
    start = F.lit(dt.datetime.fromisoformat(as_of) - dt.timedelta(days=PERIOD_DAYS[period])).cast("timestamp_ntz")
    return kpis.filter((F.col("metric_key") == metric) & F.col("is_primary") & (F.col("as_of") >= start)).orderBy("as_of", "id").select("as_of", "value")


def fuel_history(crude: DataFrame) -> DataFrame:
    """Closes of crude oil (as_of, value) as a history of fuel prices."""
    return crude.withColumn("value", F.round(F.col("value") * FUEL_FACTOR, 2))
