"""Daily editions: the day's articles ranked, cut into a front page and sections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scoring import listicle_penalty
from tidewire.functions.text import display_text
from tidewire.operators.articles import originals
from tidewire.plans.catalog import Catalog


def assemble(cat: Catalog, day: dt.date, focus: Sequence[str] = (), bonus: float = 0.25, front: int = 10) -> DataFrame:
    """article_id, section, rank (from 0): the first ``front`` articles are top stories, the others go by category."""
    start, end = (F.lit(d).cast("timestamp_ntz") for d in (day, day + dt.timedelta(days=1)))
    rows = originals(cat.articles).filter((F.col("fetched_at") >= start) & (F.col("fetched_at") < end)).join(cat.enrichment, F.col("id") == F.col("article_id"))
    score = listicle_penalty(F.col("importance_score"), F.col("headline"))
    rows = rows.select("article_id", "category", score.alias("score"), (score + F.when(F.col("category").isin(*focus), bonus).otherwise(0.0) if focus else score).alias("front_score"))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("front_score").desc(), F.col("score").desc(), "article_id")))  # one day's articles
    rows = rows.withColumn("section", F.when(F.col("place") <= front, "top_story").otherwise(F.col("category")))
    return rows.select("article_id", "section", (F.row_number().over(Window.partitionBy("section").orderBy("place")) - 1).cast("long").alias("rank"))


def assemble_days(cat: Catalog, focus: Sequence[str] = (), bonus: float = 0.25, front: int = 10) -> DataFrame:
    """edition_date, article_id, section, rank: the editions of all days at once, each as ``assemble`` makes it."""
    rows = originals(cat.articles).filter("fetched_at is not null").join(cat.enrichment, F.col("id") == F.col("article_id"))
    score = listicle_penalty(F.col("importance_score"), F.col("headline"))
    more = F.when(F.col("category").isin(*focus), bonus).otherwise(0.0) if focus else F.lit(0.0)
    rows = rows.select(F.col("fetched_at").cast("date").alias("edition_date"), "article_id", "category", score.alias("score"), (score + more).alias("front_score"))
    place = Window.partitionBy("edition_date").orderBy(F.col("front_score").desc(), F.col("score").desc(), "article_id")
    rows = rows.withColumn("place", F.row_number().over(place)).withColumn("section", F.when(F.col("place") <= front, "top_story").otherwise(F.col("category")))
    rank = F.row_number().over(Window.partitionBy("edition_date", "section").orderBy("place")) - 1
    return rows.select("edition_date", "article_id", "section", rank.cast("long").alias("rank"))


def title(translated_at: Column, headline_tr: Column, headline: Column, title_: Column) -> Column:
    """What an edition shows of an article: the translated headline only once the translation was made, else the headline, else the title."""
    return display_text(F.when(translated_at.isNotNull(), headline_tr), headline, title_)


def editions(stories: DataFrame, titles: DataFrame, most: int = 30) -> DataFrame:
    """edition_date, headline (of the first top story), story_count: the newest ``most`` editions of ``stories`` (as ``assemble_days`` gives them); ``titles`` has article_id, shown."""
    counted = stories.groupBy("edition_date").agg(F.count("*").alias("story_count"), F.min(F.when((F.col("section") == "top_story") & (F.col("rank") == 0), F.col("article_id"))).alias("_first"))
    newest = counted.orderBy(F.col("edition_date").desc()).limit(most)
    return newest.join(titles.select(F.col("article_id").alias("_first"), F.col("shown").alias("headline")), "_first", "left").select("edition_date", "headline", "story_count")


def on_date(stories: DataFrame, day: dt.date) -> DataFrame:
    """section, rank, article_id of one day's edition: top stories first, then sections by name."""
    rows = stories.filter(F.col("edition_date") == F.lit(day))
    return rows.orderBy(F.when(F.col("section") == "top_story", 0).otherwise(1), "section", "rank").select("section", "rank", "article_id")


def digest(edition: DataFrame, links: int = 3, sections: int = 5, lead: int = 7) -> DataFrame:
    """What the newsletter shows: the lead with its links, and the first links of the largest sections."""
    others = edition.filter("section <> 'top_story'")
    largest = others.groupBy("section").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "section").limit(sections).select("section")
    return edition.filter(f"section = 'top_story' and rank <= {lead}").unionByName(others.filter(F.col("rank") < links).join(largest, "section", "left_semi").select(*edition.columns))
