"""Pivots shaped at run time: two dimensions, a measure and filters, with right totals for measures that don't add up.

One CUBE (or ROLLUP, with one dimension) gives cells, both margins and the grand total in a pass; GROUPING flags tell a
null value from a total. Only the joins that the chosen dimensions and measures need are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.articles import effective_time, mentioning, mentions, originals, since
from tidewire.plans.catalog import Catalog

_PERIODS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}

#: Dimension: (what it needs to be joined, its column).
DIMENSIONS = {
    **{d: ("enrichment", lambda d=d: F.col(d)) for d in ("category", "subcategory", "region", "sentiment")},
    "source": ("sources", lambda: F.col("source_name")),
    "airline": ("airline", lambda: F.col("airline_name")),
    "translated": ("enrichment", lambda: F.when(F.col("translated_at").isNotNull(), "yes").otherwise("no")),
    **{p: ("", lambda p=p, f=f: F.date_format(F.date_trunc(p, effective_time()), f)) for p, f in _PERIODS.items()},
}
MEASURES = {
    "count": ("", lambda: F.count("*").cast("double")),
    "sources": ("", lambda: F.countDistinct("source_id").cast("double")),
    "importance": ("enrichment", lambda: F.round(F.avg("importance_score"), 3)),
    "confidence": ("enrichment", lambda: F.round(F.avg("confidence_score"), 3)),
    "corroboration": ("enrichment", lambda: F.sum("corroborating_source_count").cast("double")),
}
CHRONOLOGICAL = frozenset(_PERIODS)


def describe() -> dict[str, list[str]]:
    return {"dimensions": list(DIMENSIONS), "measures": list(MEASURES)}


def pivot(
    cat: Catalog,
    row: str,
    col: str | None = None,
    measure: str = "count",
    *,
    as_of: str | None = None,
    days: int | None = None,
    airlines: list[str] | None = None,
    sources: list[str] | None = None,
    countries: list[str] | None = None,
    airports: list[str] | None = None,
    **equal: str | list[str] | None,
) -> DataFrame:
    """row, col, row_total, col_total (flags), value; ``equal`` names enrichment columns and their value, or several.

    A filter of no values, or None, asks for nothing. Mentions and sources are filtered by semi-joins, so that an
    article with several counts once.
    """
    for name, known in ((row, DIMENSIONS), (col or row, DIMENSIONS), (measure, MEASURES)):
        if name not in known:
            raise ValueError(f"unknown: {name}; one of {', '.join(known)}")
    col = None if col == row else col
    equal = {name: value for name, value in equal.items() if value}
    needs = {DIMENSIONS[row][0], MEASURES[measure][0], *([DIMENSIONS[col][0]] if col else []), *(["enrichment"] if equal else [])}
    rows = originals(cat.articles)
    if days is not None:
        rows = rows.filter(effective_time() >= since(as_of, days))
    for kind, values, by in (("airline", airlines, "code"), ("country", countries, "name"), ("airport", airports, "code")):
        if values:
            rows = mentioning(rows, mentions(cat, kind, values, by))
    if sources:
        wanted = cat.sources.filter(F.col("name").isin(list(sources))).select(F.col("id").alias("_wanted"))
        rows = rows.join(wanted, F.col("source_id") == F.col("_wanted"), "left_semi")
    if "enrichment" in needs:
        rows = rows.join(cat.enrichment, F.col("id") == F.col("article_id"), "left")
    if "sources" in needs:
        rows = rows.join(cat.sources.select(F.col("id").alias("_source"), F.col("name").alias("source_name")), F.col("source_id") == F.col("_source"), "left")
    if "airline" in needs:  # an article counts under each of its airlines
        carriers = mentions(cat, "airline").select(F.col("article_id").alias("_a"), F.col("name").alias("airline_name"))
        rows = rows.join(carriers, F.col("id") == F.col("_a"), "left")
    for name, value in equal.items():
        rows = rows.filter(F.col(name).isin([value] if isinstance(value, str) else list(value)))
    rows = rows.withColumn("row", DIMENSIONS[row][1]())
    value = MEASURES[measure][1]().alias("value")
    if col is None:
        return rows.rollup("row").agg(value, F.grouping("row").alias("rt")).select("row", F.lit(None).cast("string").alias("col"), F.col("rt").cast("int").alias("row_total"), F.lit(1).alias("col_total"), "value")
    rows = rows.withColumn("col", DIMENSIONS[col][1]())
    cube = rows.cube("row", "col").agg(value, F.grouping("row").alias("rt"), F.grouping("col").alias("ct"))
    return cube.select("row", "col", F.col("rt").cast("int").alias("row_total"), F.col("ct").cast("int").alias("col_total"), "value")


def truncated(table: DataFrame, row: str, rows: int = 100, cols: int = 40, col: str | None = None) -> DataFrame:
    """The cells of the leading rows and columns: in order of time, or the largest first."""

    def leading(axis: str, other_total: str, most: int, name: str | None) -> DataFrame:
        totals = table.filter((F.col(f"{axis}_total") == 0) & (F.col(other_total) == 1))
        order = [F.col(axis).asc_nulls_last()] if name in CHRONOLOGICAL else [F.col("value").desc_nulls_last(), F.col(axis).asc_nulls_last()]
        return totals.orderBy(*order).limit(most).select(F.col(axis).alias(f"_{axis}"))

    kept = table.join(leading("row", "col_total", rows, row), F.col("row").eqNullSafe(F.col("_row")) | (F.col("row_total") == 1), "left_semi")
    return kept.join(leading("col", "row_total", cols, col), F.col("col").eqNullSafe(F.col("_col")) | (F.col("col_total") == 1), "left_semi")


def grand_total(table: DataFrame) -> DataFrame:
    """One row, 0 where there is nothing to sum."""
    return table.filter("row_total = 1 and col_total = 1").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


