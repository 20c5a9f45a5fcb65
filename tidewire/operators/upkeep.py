"""Repairs of a stored archive, each as the next snapshot of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean_translation, strip_publisher, vowel_harmony
from tidewire.operators.articles import since
from tidewire.storage.versions import Version, VersionedTable


def reset_enrichment(articles: DataFrame, enrichment: DataFrame, mentions: DataFrame, as_of: str | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what was derived from originals (of those fetched in the last ``days``, where given), which are to be enriched again."""
    chosen = ~F.col("is_duplicate")
    if days is not None:
        chosen = chosen & (F.col("fetched_at") >= since(as_of, days))
    gone = articles.filter(chosen).select(F.col("id").alias("article_id"))
    return articles.withColumn("status", F.when(chosen, "deduped").otherwise(F.col("status"))), enrichment.join(gone, "article_id", "left_anti"), mentions.join(gone, "article_id", "left_anti")


def cleaned_headlines(articles: DataFrame, sources: DataFrame, enrichment: DataFrame) -> DataFrame:
    """article_id, headline, changed: headlines without their publishers."""
    named = articles.select("id", "source_id").join(sources.select(F.col("id").alias("_source"), "name"), F.col("source_id") == F.col("_source"), "left")
    rows = enrichment.select("article_id", F.col("headline").alias("_old")).join(named, F.col("article_id") == F.col("id"))
    rows = rows.withColumn("headline", strip_publisher(F.col("_old"), F.coalesce("name", F.lit(""))))
    return rows.select("article_id", "headline", (~F.col("headline").eqNullSafe(F.col("_old"))).alias("changed"))


def repaired_translations(enrichment: DataFrame) -> DataFrame:
    """article_id, headline_tr, translated_at: translations without remarks and with agreeing vowels; one that can't be kept is to be made again."""
    rows = enrichment.withColumn("_new", vowel_harmony(clean_translation(F.col("headline"), F.col("headline_tr"))))
    return rows.select("article_id", F.col("_new").alias("headline_tr"), F.when(F.col("_new").isNotNull(), F.col("translated_at")).alias("translated_at"))


def reclassify(table: VersionedTable, articles: DataFrame, found: DataFrame, label: str | None = None) -> Version | None:
    """The enrichment's next version, with what is derived from texts taken from ``found`` (article_id, region and, where it is there, subcategory).

    Enriched originals only; one that ``found`` doesn't have loses its region. Translations, categories and all other
    columns stay, and partitions without a changed row aren't written. None if nothing changed.
    """
    chosen = articles.filter(~F.col("is_duplicate") & (F.col("status") == "enriched")).select(F.col("id").alias("_id"))
    derived = [c for c in ("region", "subcategory") if c in found.columns]
    new = chosen.join(found.select(F.col("article_id").alias("_f"), *(F.col(c).alias(f"_{c}") for c in derived)), F.col("_id") == F.col("_f"), "left").drop("_f")
    differs = ~F.lit(True)
    for c in derived:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = table.read().join(new, F.col("article_id") == F.col("_id")).filter(differs).select("article_id")

    def rewritten(old: DataFrame) -> DataFrame:
        joined = old.join(new, F.col("article_id") == F.col("_id"), "left")
        return joined.withColumns({c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in derived})

    return table.change(changed, rewritten, label)
