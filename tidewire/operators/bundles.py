"""Bundles: several listings that are asked for together, each from one pass over the articles or readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scoring import percent_change
from tidewire.operators.articles import mentions, originals, since
from tidewire.operators.insights import _windows
from tidewire.plans.catalog import Catalog


def insights(cat: Catalog, as_of: str, days: int, route_category: str) -> DataFrame:
    """part (momentum, sentiment or routes), key, and the counts of each part, from one pass.

    An article is expanded once, to a row for each of its airlines, of which the first stands for the article. Grouping
    sets over airline, category and region make the parts, told apart by the grouping's number.
    """
    current, previous = _windows(as_of, days)
    named = mentions(cat, "airline").groupBy("article_id").agg(F.collect_list(F.coalesce("code", "name")).alias("codes"))
    rows = originals(cat.articles).filter(F.col("published_at") >= since(as_of, 2 * days)).select("id", "published_at")
    rows = rows.join(cat.enrichment.select("article_id", "category", "region", "sentiment"), F.col("id") == F.col("article_id"), "left").withColumn("enriched", F.col("article_id").isNotNull()).drop("article_id")
    rows = rows.join(named, F.col("id") == F.col("article_id"), "left")
    each = rows.select("published_at", "category", "region", "sentiment", "enriched", F.posexplode_outer("codes").alias("nth", "code"))
    recent = F.coalesce(F.col("nth"), F.lit(0)).eqNullSafe(0) & F.col("enriched") & (F.col("published_at") >= since(as_of, days))
    count = lambda condition: F.count_if(condition)
    routes = recent & (F.col("category") == route_category) & F.col("region").isNotNull()
    sets = each.groupingSets([["code"], ["category"], ["region"]], "code", "category", "region").agg(
        F.grouping_id().alias("of"), count(current & F.col("code").isNotNull()).alias("current"), count(previous & F.col("code").isNotNull()).alias("previous"),
        *(count(recent & (F.col("sentiment") == s)).alias(s) for s in ("positive", "neutral", "negative")), count(recent).alias("articles"), count(routes).alias("routes"),
    )
    # one bit a column that isn't grouped by, the first column's the highest
    part = F.when(F.col("of") == 0b011, "momentum").when(F.col("of") == 0b101, "sentiment").otherwise("routes")
    key = F.when(F.col("of") == 0b011, F.col("code")).when(F.col("of") == 0b101, F.col("category")).otherwise(F.col("region"))
    some = F.when(F.col("of") == 0b011, F.col("current") + F.col("previous")).when(F.col("of") == 0b101, F.col("articles")).otherwise(F.col("routes"))
    of = lambda name, *columns: [F.when(F.col("part") == name, F.col(c)).alias(c) for c in columns]
    out = sets.filter(some > 0).select(part.alias("part"), key.alias("key"), "current", "previous", "positive", "neutral", "negative", "routes")
    return out.select("part", "key", *of("momentum", "current", "previous"), *of("sentiment", "positive", "neutral", "negative"), *of("routes", "routes"))


def envelope(bundle: DataFrame, movers: int = 10) -> DataFrame:
    """One row, json: the bundle as the answer of an interface; movers are those that moved most, the other lists go by key."""
    delta = F.col("current") - F.col("previous")
    top = bundle.filter("part = 'momentum'").orderBy(F.abs(delta).desc(), F.col("current").desc(), "key").limit(movers)
    kept = top.unionByName(bundle.filter("part <> 'momentum'"))  # as few as there are movers, categories and regions
    listed = lambda name, *fields: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct(*fields)))), lambda x: x["v"])
    moved = listed("momentum", (-F.abs(delta)).alias("d"), (-F.col("current")).alias("c"), F.col("key").alias("k"), F.struct(F.col("key").alias("code"), "current", "previous", delta.alias("delta")).alias("v"))
    felt = listed("sentiment", F.col("key").alias("k"), F.struct(F.col("key").alias("category"), "positive", "neutral", "negative").alias("v"))
    went = listed("routes", F.col("key").alias("k"), F.struct(F.col("key").alias("region"), F.col("routes").alias("count")).alias("v"))
    answer = kept.agg(moved.alias("airline_momentum"), went.alias("new_route_signals"), felt.alias("sentiment_by_category"))
    return answer.select(F.to_json(F.struct("airline_momentum", "new_route_signals", "sentiment_by_category"), {"ignoreNullFields": "false"}).alias("json"))


def kpis(readings: DataFrame, year: int, points: int = 12) -> DataFrame:
    """metric_key, as_of, value, previous, change, ly_value, ly_change and trend (the last ``points`` values, oldest first), from one pass."""
    primary = readings.filter("is_primary")
    order = Window.partitionBy("metric_key").orderBy(F.col("as_of").desc(), F.col("id").desc())
    inside = (F.col("as_of") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("as_of") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))
    rows = primary.withColumn("nth", F.row_number().over(order))
    at = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    newest = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= points, F.struct((-F.col("nth")).alias("n"), "value")))), lambda x: x["value"])
    by_metric = rows.groupBy("metric_key").agg(at(1, "as_of").alias("as_of"), at(1, "value").alias("value"), at(2, "value").alias("previous"), F.min_by("value", F.when(inside, F.col("nth"))).alias("ly_value"), newest.alias("trend"))
    return by_metric.select("metric_key", "as_of", "value", "previous", percent_change(F.col("value"), F.col("previous")).alias("change"), "ly_value", percent_change(F.col("value"), F.col("ly_value")).alias("ly_change"), "trend")


def article_details(cat: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` (articles) with source, enrichment and entities nested in each; an article without either has nulls, or an empty list.

    Entities are gathered by article before the join, and only those of the articles asked for.
    """
    links = cat.article_entities.join(rows.select(F.col("id").alias("_a")), F.col("article_id") == F.col("_a"), "left_semi")
    entity = F.struct("entity_type", "code", "name")
    gathered = links.join(cat.entities, F.col("entity_id") == F.col("id")).groupBy("article_id").agg(F.array_sort(F.collect_list(entity)).alias("entities")).withColumnRenamed("article_id", "_e")
    source = cat.sources.select(F.col("id").alias("_s"), F.struct("id", "name", "category", "trust_weight").alias("source"))
    enriched = cat.enrichment.select(F.col("article_id").alias("_n"), F.struct(*(c for c in cat.enrichment.columns if c != "article_id")).alias("enrichment"))
    out = rows.join(source, F.col("source_id") == F.col("_s"), "left").join(enriched, F.col("id") == F.col("_n"), "left").join(gathered, F.col("id") == F.col("_e"), "left")
    none = F.array().cast(gathered.schema["entities"].dataType)
    return out.withColumn("entities", F.coalesce("entities", none)).drop("_s", "_n", "_e")


def names_of(entities: str, kind: str) -> Column:
    """Codes (or names without one) of one kind in a nested list."""
    return F.transform(F.filter(entities, lambda e: e["entity_type"] == kind), lambda e: F.coalesce(e["code"], e["name"]))
