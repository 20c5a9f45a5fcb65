"""Lists of places and of regions' articles, in the order of a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order_of(name: Column, language: str = "tr") -> Column:
    """``name`` to be sorted by, as the language sorts it: a collation, not the order of code points."""
    return F.collate(name, language)


def by_region(places: DataFrame, language: str = "tr", unknown: str = "other") -> DataFrame:
    """region, place, n, nth: ``places`` (place, n, region) by region, names in the language's order within it; unknown regions are one."""
    rows = places.withColumn("region", F.coalesce("region", F.lit(unknown)))
    # ties of the collation go by code point; a region's places are few
    order = Window.partitionBy("region").orderBy(in_order_of(F.col("place"), language), "place")
    return rows.withColumn("nth", F.row_number().over(order).cast("long")).select("region", "place", "n", "nth")


def groups(rows: DataFrame, most: int = 6) -> DataFrame:
    """region, articles: the newest ``most`` of each region's ``rows`` (id, region, published_at, airlines: an array) as a list."""
    newest = Window.partitionBy("region").orderBy(F.col("published_at").desc(), "id")
    top = rows.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= most)
    return top.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "airlines"))).alias("articles"))


def narrowed(grouped: DataFrame, region: str | None = None, airline: str | None = None) -> DataFrame:
    """region, id: groups flattened again, of one region or with one airline only; arrays are filtered in place."""
    rows = grouped if region is None else grouped.filter(F.col("region") == region)
    kept = F.col("articles") if airline is None else F.filter("articles", lambda a: F.array_contains(a["airlines"], airline))
    return rows.select("region", F.explode(F.transform(kept, lambda a: a["id"])).alias("id"))
