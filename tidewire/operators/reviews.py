"""Reviews: themes, sentiment and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scoring import keyword_pattern, rating_sentiment
from tidewire.functions.text import normalize, once


def themes(normal: Column, keywords: Mapping[str, Sequence[str]], most: int = 3) -> Column:
    """The themes that a text in its normal form hits most, ties by name."""
    hits = F.array(*(F.struct((-F.regexp_count(normal, F.lit(keyword_pattern(ws)))).alias("n"), F.lit(t).alias("theme")) for t, ws in keywords.items()))
    return F.transform(F.slice(F.array_sort(F.filter(hits, lambda h: h["n"] < 0)), 1, most), lambda h: h["theme"])


def tagged(reviews: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """``reviews`` with themes and sentiment (by rating; unrated ones are neutral)."""
    # as a generator's output, the normal form and the themes are made once a text, whatever is asked of them afterwards
    rows = once(once(reviews, "_normal", normalize(F.col("body"))), "themes", themes(F.col("_normal"), keywords))
    return rows.withColumn("sentiment", rating_sentiment(F.col("rating"), F.lit("neutral"))).drop("_normal")


def theme_stats(reviews: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """theme, n, positive, negative, newest (id of the newest review)."""
    rows = tagged(reviews, keywords).select("id", "review_date", "sentiment", F.explode("themes").alias("theme"))
    count = lambda s: F.count_if(F.col("sentiment") == s).alias(s)
    return rows.groupBy("theme").agg(F.count("*").alias("n"), count("positive"), count("negative"), F.max(F.struct("review_date", "id"))["id"].alias("newest"))


def overall(reviews: DataFrame) -> DataFrame:
    """One row: reviews, rated ones and their mean, and the sentiments."""
    rows = reviews.withColumn("sentiment", rating_sentiment(F.col("rating"), F.lit("neutral")))
    count = lambda s: F.count_if(F.col("sentiment") == s).alias(s)
    return rows.agg(F.count("*").alias("n"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 1).alias("mean_rating"), count("positive"), count("neutral"), count("negative"))


def theme_windows(today: str, days: int) -> tuple[Column, Column]:
    """Whether a review is of the last ``days``, or of as many before; what is undated is of neither."""
    start, before = (F.date_sub(F.lit(today).cast("date"), n) for n in (days, 2 * days))
    return F.col("review_date") >= start, (F.col("review_date") >= before) & (F.col("review_date") < start)


def windowed_themes(reviews: DataFrame, keywords: Mapping[str, Sequence[str]], today: str, days: int) -> DataFrame:
    """id, review_date, sentiment, theme of the reviews of both windows, a row a theme."""
    current, previous = theme_windows(today, days)
    return tagged(reviews.filter(current | previous), keywords).select("id", "review_date", "sentiment", F.explode("themes").alias("theme"))


def growth(rows: DataFrame, today: str, days: int, least: int = 3, factor: float = 1.5) -> DataFrame:
    """theme, current, previous, severity of the themes of ``windowed_themes`` that grow from one window to the next."""
    current, previous = theme_windows(today, days)
    counted = rows.groupBy("theme").agg(F.count_if(current).alias("current"), F.count_if(previous).alias("previous"), F.count_if(current & (F.col("sentiment") == "negative")).alias("bad"))
    grown = counted.filter((F.col("current") >= least) & (F.col("current") >= factor * F.col("previous")))
    return grown.select("theme", "current", "previous", F.when(F.col("bad") / F.col("current") >= 0.6, "high").otherwise("medium").alias("severity"))


def theme_growth(reviews: DataFrame, keywords: Mapping[str, Sequence[str]], today: str, days: int, least: int = 3, factor: float = 1.5) -> DataFrame:
    """theme, current, previous, severity of themes that grow from one window to the next."""
    return growth(windowed_themes(reviews, keywords, today, days), today, days, least, factor)
