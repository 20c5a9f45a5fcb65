"""Places in the news: counts, co-mention routes and a place's own page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.articles import effective_time, mentioning, mentions, originals, since
from tidewire.plans.catalog import Catalog
from tidewire.storage.folder import written


def _recent(cat: Catalog, as_of: str, days: int) -> DataFrame:
    return originals(cat.articles).filter(effective_time() >= since(as_of, days)).select("id")


def place_counts(cat: Catalog, as_of: str, days: int, kind: str = "airport", by: str = "code") -> DataFrame:
    """Every known place with its articles, 0 where there are none."""
    recent = _recent(cat, as_of, days)
    found = mentions(cat, kind, within=recent).select("article_id", F.col(by).alias("place")).distinct()
    counted = recent.join(found, F.col("id") == F.col("article_id")).groupBy(F.col("place").alias("_place")).agg(F.count("*").alias("n"))
    known = cat.entities.filter(F.col("entity_type") == kind).select(F.col(by).alias("place")).distinct()
    return known.join(counted, F.col("place") == F.col("_place"), "left").select("place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def routes(cat: Catalog, as_of: str, days: int, least: int = 2, top: int = 40) -> DataFrame:
    """origin, destination, n: pairs of places that ``least`` articles or more mention together, in one order.

    An article's places are gathered and paired within its row, so the join is by article and grows with the square of
    the places in one article only.
    """
    recent = _recent(cat, as_of, days)
    found = mentions(cat, "airport", within=recent).select("article_id", "code").distinct()
    # written, so that the mentions are made once and not for either side
    rows = written(recent.join(found, F.col("id") == F.col("article_id")).select("id", "code"), "mentioned-places")
    other = rows.select(F.col("id").alias("_id"), F.col("code").alias("_code"))
    pairs = rows.join(other, (F.col("id") == F.col("_id")) & (F.col("code") < F.col("_code")))
    counted = pairs.groupBy(F.col("code").alias("origin"), F.col("_code").alias("destination")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.orderBy(F.col("n").desc(), "origin", "destination").limit(top)


def place_detail(cat: Catalog, code: str, as_of: str, days: int, carriers: int = 8) -> DataFrame:
    """kind, name, n: a place's articles in all, by category, and by its leading carriers."""
    rows = mentioning(_recent(cat, as_of, days), mentions(cat, "airport", [code]))
    total = rows.agg(F.lit("total").alias("kind"), F.lit("").alias("name"), F.count("*").alias("n"))
    of_category = rows.join(cat.enrichment, F.col("id") == F.col("article_id")).groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n")
    found = mentions(cat, "airline").select("article_id", "code").distinct()
    of_carrier = rows.join(found, F.col("id") == F.col("article_id")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(carriers)
    return total.unionByName(of_category).unionByName(of_carrier.select(F.lit("carrier").alias("kind"), F.col("code").alias("name"), "n"))


def located(found: DataFrame, places: DataFrame) -> DataFrame:
    """``found`` (origin, destination, ...) with the coordinates of both ends, where ``places`` (code, lat, lon) has both."""
    end = lambda side: places.select(F.col("code").alias(f"_{side}"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    rows = found.join(end("origin"), F.col("origin") == F.col("_origin")).join(end("destination"), F.col("destination") == F.col("_destination"))
    return rows.drop("_origin", "_destination")


def with_regions(counts: DataFrame, regions: DataFrame, unknown: str = "other") -> DataFrame:
    """``counts`` (place, n) with the region of ``regions`` (name, region), whatever the case of a name."""
    known = regions.select(F.lower("name").alias("_name"), F.col("region"))
    return counts.join(known, F.lower("place") == F.col("_name"), "left").select("place", "n", F.coalesce("region", F.lit(unknown)).alias("region"))
