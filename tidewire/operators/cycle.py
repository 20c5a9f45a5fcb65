"""One intake cycle as a composition: new items, exact and near duplicates, enrichment, stories, and scores.

Each step gives tables that the next one takes; the tables between them are written, so that a lost executor costs a
step and not the cycle. A cycle over no items gives the archive as it was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scoring import confidence, importance, lexicon_sentiment
from tidewire.functions.text import content_hash, word_count
from tidewire.operators import dedup, enrich, ids
from tidewire.operators.articles import at, new_rows
from tidewire.storage.folder import written

#: Characters of a title and of an author's name that are stored.
TITLE_CHARS, AUTHOR_CHARS = 500, 200
ARTICLE = ("id", "source_id", "url", "title", "body", "author", "published_at", "fetched_at", "word_count", "hash", "status", "is_duplicate", "duplicate_of_id")
ENRICHED = ("article_id", "category", "sentiment", "region", "headline_tr")


@dataclass(frozen=True)
class Rules:
    """What the enrichment goes by: keywords by category and by feeling, names with their aliases, and regions of countries and airports."""

    taxonomy: Mapping[str, Sequence[str]]
    positive: Sequence[str]
    negative: Sequence[str]
    gazetteer: DataFrame
    country_regions: DataFrame
    airport_countries: DataFrame


def taken_in(articles: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """New articles from ``items`` (source_id, url, title, content, author, published_at): of each unseen address the first, with ids after the archive's."""
    fresh = new_rows(items.filter("url is not null and title is not null"), articles, "url", "title")
    last = articles.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = ids.numbered(fresh, ["url"], last + 1)
    title, body = F.substring("title", 1, TITLE_CHARS), F.coalesce("content", F.lit(""))
    made = {"title": title, "body": body, "author": F.substring("author", 1, AUTHOR_CHARS), "fetched_at": at(now), "word_count": word_count(body), "hash": content_hash(title, body), "status": F.lit("new"), "is_duplicate": F.lit(False), "duplicate_of_id": F.lit(None).cast("long")}
    return rows.select(*((made[c] if c in made else F.col(c)).alias(c) for c in ARTICLE))


def deduplicated(articles: DataFrame, now: str, days: int) -> DataFrame:
    """``articles``, of which new ones are duplicates or deduped."""
    rows = articles.select("id", "title", F.col("body").alias("text"), F.coalesce("published_at", "fetched_at").alias("time"), "fetched_at", "status")
    found = written(dedup.first_pass(rows, now, days).select(F.col("id").alias("_id"), "duplicate_of"), "first-pass")
    joined = articles.join(found, F.col("id") == F.col("_id"), "left")
    lost = F.col("duplicate_of").isNotNull()
    status = F.when(lost, "duplicate").when(F.col("_id").isNotNull(), "deduped").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "is_duplicate": F.col("is_duplicate") | lost, "duplicate_of_id": F.coalesce("duplicate_of", "duplicate_of_id")}).select(*articles.columns)


def enriched(articles: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``articles`` with those that were deduped enriched, and these articles' enrichment and entities (id, entity_type, name, code)."""
    pending = written(articles.filter("status = 'deduped' and not is_duplicate").select("id", "title", "body"), "pending")
    scored = enrich.relevance(pending, rules.taxonomy, {}, [], [], []).select("id", "category")
    found = written(enrich.entities(pending, rules.gazetteer, "title", "body"), "found-entities")
    feeling = pending.select(F.col("id").alias("_f"), lexicon_sentiment(F.concat_ws(" ", "title", "body"), rules.positive, rules.negative).alias("sentiment"))
    where = enrich.regions(found, rules.country_regions, rules.airport_countries).withColumnRenamed("id", "_r")
    made = scored.join(feeling, F.col("id") == F.col("_f")).join(where, F.col("id") == F.col("_r"), "left")
    new = made.select(F.col("id").alias("article_id"), "category", "sentiment", "region", F.lit(None).cast("string").alias("headline_tr"))
    done = articles.withColumn("status", F.when((F.col("status") == "deduped") & ~F.col("is_duplicate"), "enriched").otherwise(F.col("status")))
    return done, new, found.select("id", "entity_type", "name", "code")


def run(articles: DataFrame, enrichment: DataFrame, links: DataFrame, sources: DataFrame, items: DataFrame, rules: Rules, now: str, days: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Articles, enrichment, links (article_id, entity_id: a name with its type) and scores (id, n_sources, confidence, importance) after a cycle."""
    all_ = written(articles.select(*ARTICLE).unionByName(taken_in(articles, items, now)), "articles")
    all_ = written(deduplicated(all_, now, days), "articles")
    all_, made, found = enriched(all_, rules)
    enrichment = written(enrichment.select(*ENRICHED).unionByName(made), "enrichment")
    links = written(links.select("article_id", "entity_id").unionByName(found.select(F.col("id").alias("article_id"), F.concat_ws(":", "entity_type", "name").alias("entity_id"))), "links")
    all_ = written(dedup.second_pass(all_, enrichment, links, now, days), "articles")
    scores = dedup.corroboration(all_, sources).withColumn("confidence", confidence(F.col("n_sources"), F.col("mean_trust")))
    return all_, enrichment, links, scores.select("id", "n_sources", "confidence", importance(F.col("confidence"), F.col("n_sources")).alias("importance"))
