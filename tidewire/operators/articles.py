"""Article listings and counts: filters, semi-joins on mentions, paging and series of counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.catalog import Catalog


def effective_time() -> Column:
    """Publication, or where that is unknown the time of fetching."""
    return F.coalesce("published_at", "fetched_at")


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def since(as_of: str, days: int) -> Column:
    """``days`` before ``as_of``, as a literal that filters can push down."""
    return F.lit(dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)).cast("timestamp_ntz")


def originals(articles: DataFrame) -> DataFrame:
    return articles.filter(~F.col("is_duplicate"))


def mentions(cat: Catalog, kind: str, values: list[str] | None = None, by: str = "code", within: DataFrame | None = None) -> DataFrame:
    """article_id, code, name of the mentions of one kind of entity, whatever the case of ``values``; of the articles ``within`` (id, ...) only, if given."""
    entities = cat.entities.filter(F.col("entity_type") == kind)
    if values:
        entities = entities.filter(F.lower(by).isin([v.lower() for v in values]))
    # the semi-join goes below the distinct of each kind of mention, so that other kinds are dropped before they are held and shuffled
    found = cat.article_entities.join(entities.select(F.col("id").alias("_wanted")), F.col("entity_id") == F.col("_wanted"), "left_semi")
    if within is not None:
        found = mentioned_by(found, within)
    return found.join(entities, F.col("entity_id") == F.col("id")).select("article_id", "entity_id", "code", "name")


def mentioned_by(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """``mentions`` of ``articles`` (id, ...) only; the semi-join goes below their distinct as well."""
    return mentions.join(articles.select(F.col("id").alias("_within")), F.col("article_id") == F.col("_within"), "left_semi")


def mentioning(articles: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """A semi-join, so that an article with several mentions stays one row."""
    return articles.join(found.select(F.col("article_id").alias("_mentioned")), F.col(id_col) == F.col("_mentioned"), "left_semi")


def _one_of(column: str, wanted: str | list[str] | None) -> list[Column]:
    """Condition that a column is a value or one of several; None and no values at all ask for nothing."""
    if not wanted:
        return []
    return [F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted))]


def filtered(
    cat: Catalog,
    *,
    category: str | list[str] | None = None,
    subcategory: str | list[str] | None = None,
    region: str | list[str] | None = None,
    sentiment: str | list[str] | None = None,
    sources: list[str] | None = None,
    as_of: str | None = None,
    days: int | None = None,
    on_date: dt.date | None = None,
    translated: bool | None = None,
    airlines: list[str] | None = None,
    country: str | None = None,
    airport: str | None = None,
) -> DataFrame:
    """Original articles with their enrichment under all the conditions that are given.

    Articles without an enrichment are left out by conditions on it only. An empty list of ``airlines`` asks for any
    airline at all, ``sources`` are names. The published-only window drops rows without a date.
    """
    rows = originals(cat.articles)
    if days is not None:
        rows = rows.filter(F.col("published_at") >= since(as_of, days))
    if on_date is not None:
        day = F.lit(on_date).cast("timestamp_ntz")
        rows = rows.filter((effective_time() >= day) & (effective_time() < F.lit(on_date + dt.timedelta(days=1)).cast("timestamp_ntz")))
    if airlines is not None:
        rows = mentioning(rows, mentions(cat, "airline", airlines))
    if country is not None:
        rows = mentioning(rows, mentions(cat, "country", [country], "name"))
    if airport is not None:
        rows = mentioning(rows, mentions(cat, "airport", [airport]))
    for name in _one_of("name", sources):
        rows = rows.join(cat.sources.filter(name).select(F.col("id").alias("_source")), F.col("source_id") == F.col("_source"), "left_semi")
    asked = [x for column, value in (("category", category), ("subcategory", subcategory), ("region", region), ("sentiment", sentiment)) for x in _one_of(column, value)]
    if translated is not None:
        asked.append(F.col("translated_at").isNotNull() if translated else F.col("translated_at").isNull())
    rows = rows.join(cat.enrichment, F.col("id") == F.col("article_id"), "inner" if asked else "left")
    for condition in asked:
        rows = rows.filter(condition)
    return rows


def page_with_total(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page and, in each of its rows, how many there are in all."""
    return newest(rows, limit, offset).withColumn("total", rows.agg(F.count("*")).scalar())


def newest(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order of publication; the id makes it a total order."""
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "id").offset(offset).limit(limit)


def most_important(rows: DataFrame, limit: int) -> DataFrame:
    """The most important articles first, unrated ones last, newer ones before older."""
    return rows.orderBy(F.col("importance_score").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "id").limit(limit)


def known_urls(urls: DataFrame, cat: Catalog) -> DataFrame:
    """Those of ``urls`` (url) that an article has."""
    return urls.join(cat.articles.select("url"), "url", "left_semi")


def suspicious_translations(rows: DataFrame, marks: list[str], times: int = 4, more: int = 40) -> DataFrame:
    """Articles whose translated headline holds one of ``marks`` in any case, or is out of proportion to its source."""
    condition = F.length("headline_tr") > times * F.length("headline") + more
    for mark in marks:
        condition = condition | F.col("headline_tr").ilike(f"%{mark}%")
    return rows.filter(condition)


def facets(rows: DataFrame, column: str) -> DataFrame:
    """value, n, share (in per cent of all rows with a value) for each value that is present."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = rows.filter(F.col(column).isNotNull()).agg(F.count("*")).scalar()
    return counted.select("value", "n", F.round(100 * F.col("n") / total, 1).alias("share"))


def by_day(rows: DataFrame) -> DataFrame:
    """day (undated for articles without a date), n and place: days from the newest on, undated ones last."""
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("undated"))
    counted = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    # a row for each day: few enough for one window
    order = Window.orderBy(F.when(F.col("day") == "undated", 1).otherwise(0), F.col("day").desc())
    return counted.withColumn("place", F.row_number().over(order).cast("long"))


def count_by_category(cat: Catalog, **conditions) -> DataFrame:
    return filtered(cat, **conditions).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def count_by_day(cat: Catalog, as_of: str, days: int) -> DataFrame:
    """A row for each of the last days, with zeros."""
    last = dt.date.fromisoformat(as_of[:10])
    first = last - dt.timedelta(days=days - 1)
    strip = cat.spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    rows = originals(cat.articles).filter((effective_time() >= F.lit(first).cast("timestamp_ntz")) & (effective_time() < F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz")))
    counted = rows.groupBy(effective_time().cast("date").alias("of")).agg(F.count("*").alias("n"))
    return strip.join(counted, F.col("day") == F.col("of"), "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def volume_by_week(cat: Catalog, as_of: str, weeks: int, top: int = 6) -> DataFrame:
    """week (its Monday), category, n for the largest categories; weeks without an article have zeros."""
    rows = filtered(cat, as_of=as_of, days=7 * weeks).filter("category is not null").select("category", F.date_trunc("week", "published_at").cast("date").alias("week"))
    counts = rows.groupBy("week", "category").agg(F.count("*").alias("n"))
    leading = counts.groupBy("category").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "category").limit(top).select("category")
    frame = counts.select("week").distinct().crossJoin(F.broadcast(leading))  # weeks of the window times `top` rows
    return frame.join(counts, ["week", "category"], "left").select("week", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def total_of(rows: DataFrame, on_page: int, limit: int, offset: int = 0) -> int:
    """How many ``rows`` there are in all, for a page of ``on_page``: a page that isn't full says so itself, and nothing is counted."""
    return offset + on_page if on_page < limit and (on_page or not offset) else rows.count()


def taxonomy(enrichment: DataFrame, general: str = "general") -> DataFrame:
    """slug, subcategories (in order) of the categories in use, and the general one, which has none."""
    used = enrichment.groupBy(F.col("category").alias("slug")).agg(F.sort_array(F.collect_set("subcategory")).alias("subcategories"))
    none = enrichment.sparkSession.range(1).select(F.lit(general).alias("slug"), F.array().cast("array<string>").alias("subcategories"))
    return used.filter(~F.col("slug").eqNullSafe(general)).unionByName(none)


def not_enriched(cat: Catalog) -> DataFrame:
    return originals(cat.articles).join(cat.enrichment, F.col("id") == F.col("article_id"), "left_anti")


def two_ended(rows: DataFrame, limit: int, share: float = 0.35) -> DataFrame:
    """The newest ``limit`` and, against starvation, some of the oldest; each row once."""
    newest_ = newest(rows, limit)
    oldest = rows.orderBy(F.col("fetched_at").asc(), "id").limit(max(1, round(limit * share)))
    return newest_.unionByName(oldest).dropDuplicates(["id"])


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows of unseen keys, of each key the first."""
    first = incoming.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_nth = 1").drop("_nth")
    return first.join(existing.select(F.col(key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")


def search(docs: DataFrame, query: str, text_col: str, id_col: str) -> DataFrame:
    """id, rank of the texts that hold every word of the query: occurrences, less for long texts. No stemming."""
    from tidewire.functions.text import once, tokens

    words = sorted(set(query.lower().split()))
    # as a generator's output the words are made once a text, not for each that is asked for
    rows = once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "w", tokens(F.col("text")))
    hits = [F.size("w") - F.size(F.array_remove("w", q)) for q in words]
    rows = rows.select("id", F.size("w").alias("n"), F.array(*hits).alias("hits")).filter(F.forall("hits", lambda h: h > 0))
    total = F.aggregate("hits", F.lit(0), lambda a, b: a + b)
    return rows.select("id", F.round(total / (1 + F.log(F.col("n").cast("double"))), 6).alias("rank"))
