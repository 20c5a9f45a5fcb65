"""Local enrichment of articles: relevance, subcategories, entities by a gazetteer, and regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scoring import hits, keyword_pattern
from tidewire.functions.text import normalize, tokens

# What a decisive term or a watched carrier in the title is worth, what makes up for a missing body, the
# length below which a body is a stub, and the evidence and margin that overrule a chosen category.
DECISIVE_BONUS, WATCHED_BONUS, STUB_BONUS, STUB_CHARS = 6, 6, 3, 120
LEAST_EVIDENCE, MARGIN = 3, 2


def _best(scored: Sequence[tuple[str, Column]]) -> Column:
    """score and slug of the highest score, the first on ties."""
    return F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("ord"), F.lit(slug).alias("slug")) for i, (slug, s) in enumerate(scored))))


def relevance(
    rows: DataFrame,
    taxonomy: Mapping[str, Sequence[str]],
    focus: Mapping[str, int],
    commercial: Sequence[str],
    decisive: Sequence[str],
    watched: Sequence[str],
    default: str = "general",
) -> DataFrame:
    """id, title and body in normal form, raw (score by category), category and score of ``rows`` (id, title, body).

    The category is the one of the highest score by its weight in ``focus``. Normal forms and counts are columns of
    their own, so that each is made once a row.
    """
    stub = F.length(F.coalesce("body", F.lit(""))) < STUB_CHARS
    plain = rows.select("id", normalize(F.col("title")).alias("title"), normalize(F.col("body")).alias("body"), stub.alias("stub"))
    t, b = F.col("title"), F.col("body")
    raw = F.array(*(F.struct(F.lit(c).alias("category"), hits(t, b, ks).alias("score")) for c, ks in taxonomy.items()))
    counted = plain.withColumns({"raw": raw, "commercial": hits(t, b, commercial)})
    best = counted.withColumn("best", _best([(c, F.col("raw")[i]["score"] * focus.get(c, 1)) for i, c in enumerate(taxonomy)]))
    bonus = lambda terms, worth: F.when(t.rlike(keyword_pattern(terms)), worth).otherwise(0)
    headline_only = F.when(F.col("stub") & (F.col("commercial") > 0), STUB_BONUS).otherwise(0)
    score = F.col("best.score") + F.col("commercial") + bonus(decisive, DECISIVE_BONUS) + bonus(watched, WATCHED_BONUS) + headline_only
    return best.select("id", "title", "body", "raw", F.when(F.col("best.score") > 0, F.col("best.slug")).otherwise(default).alias("category"), score.cast("long").alias("score"))


def overruled(chosen: Column, raw: Column) -> Column:
    """The category that the keywords clearly point to instead of the chosen one, else null; a tie for first place points nowhere."""
    top = F.array_max(F.transform(raw, lambda x: x["score"]))
    first = F.filter(raw, lambda x: x["score"] == top)
    own = F.coalesce(F.get(F.filter(raw, lambda x: x["category"] == chosen), F.lit(0))["score"], F.lit(0))
    return F.when((F.size(first) == 1) & (top >= LEAST_EVIDENCE) & (top - own >= MARGIN), F.get(first, F.lit(0))["category"])


def subcategory(title: Column, body: Column, category: Column, keywords: Mapping[str, Mapping[str, Sequence[str]]], exempt: Sequence[str] = ("events",)) -> Column:
    """The subcategory of the highest score within a category, from a title and body in normal form; null without a hit or in a flat category."""
    out = F.lit(None).cast("string")
    for c, subs in keywords.items():
        scored = [(s, hits(title, body, ks)) for s, ks in subs.items() if ks]
        if scored and c not in exempt:
            best = _best(scored)
            out = F.when(category == c, F.when(best["score"] > 0, best["slug"])).otherwise(out)
    return out


def entities(rows: DataFrame, gazetteer: DataFrame, *texts: str) -> DataFrame:
    """id, entity_type, name, code and ord of the entities whose aliases occur in ``rows`` as whole words, each once.

    ``gazetteer`` has alias (in normal form), entity_type, name, code and ord. The runs of words of a text, up to the
    longest alias, are joined to it by hash, so the work grows with the texts and not with texts times aliases.
    """
    longest = gazetteer.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 0
    words = rows.select("id", tokens(F.concat_ws(" ", *texts)).alias("w"))
    w = F.col("w")
    runs = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    offered = words.select("id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *(runs(k) for k in range(1, longest + 1))))).alias("alias"))
    found = offered.join(gazetteer, "alias")
    return found.groupBy("id", "entity_type", "name").agg(F.min_by("code", "ord").alias("code"), F.min("ord").alias("ord"))


def regions(found: DataFrame, country_regions: DataFrame, airport_countries: DataFrame) -> DataFrame:
    """id and region: of the first country (of ``entities``) that has one, else of the first airport whose country has one.

    ``country_regions`` has country (in lower case) and region, ``airport_countries`` code and country.
    """
    named = found.filter("entity_type = 'country'").select("id", F.lower("name").alias("country"), F.lit(0).alias("tier"), "ord")
    served = found.filter("entity_type = 'airport'").join(airport_countries, "code").select("id", "country", F.lit(1).alias("tier"), "ord")
    return named.union(served).join(country_regions, "country").groupBy("id").agg(F.min_by("region", F.struct("tier", "ord")).alias("region"))
