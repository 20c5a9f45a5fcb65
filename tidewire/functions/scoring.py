"""Scores of articles as columns: keyword evidence, sentiment, confidence and importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import normalize, tokens


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Whole words of the normal form; keywords are brought to that form as well."""
    import re

    plain = [re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", k.lower())).strip() for k in keywords]
    return r"\b(?:" + "|".join(filter(None, plain)) + r")\b"


def hits(title: Column, body: Column, keywords: Sequence[str]) -> Column:
    """Three for each hit in a title, one for each in a body, both in normal form; of keywords that start alike, the first in the list is taken."""
    pattern = F.lit(keyword_pattern(keywords))
    return (3 * F.regexp_count(title, pattern) + F.regexp_count(body, pattern)).cast("long")


def keyword_score(title: Column, body: Column, keywords: Sequence[str]) -> Column:
    """``hits`` of texts as they are."""
    return hits(normalize(title), normalize(body), keywords)


def best_category(title: Column, body: Column, taxonomy: Mapping[str, Sequence[str]], default: str = "general") -> Column:
    """The category of the highest score; the first of the taxonomy on ties, ``default`` without a hit."""
    scored = [F.struct(keyword_score(title, body, ks).alias("score"), F.lit(-i).alias("ord"), F.lit(c).alias("slug")) for i, (c, ks) in enumerate(taxonomy.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["slug"]).otherwise(F.lit(default))


def lexicon_sentiment(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """By the number of distinct words of either lexicon; neutral on ties."""
    words = F.array_distinct(tokens(text))
    hits = lambda ws: F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))
    up, down = hits(positive), hits(negative)
    return F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")


def rating_sentiment(rating: Column, otherwise: Column) -> Column:
    """Ratings of seven and more are positive, four and less negative; without one the text decides."""
    return F.when(rating >= 7, "positive").when(rating <= 4, "negative").when(rating.isNotNull(), "neutral").otherwise(otherwise)


def confidence(n_sources: Column, mean_trust: Column) -> Column:
    raw = 0.4 + 0.15 * (n_sources - 1) + 0.3 * mean_trust
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3)


def importance(confidence_: Column, corroborations: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.7 * confidence_ + 0.06 * F.least(corroborations, F.lit(5))), 3)


def is_listicle(headline: Column) -> Column:
    """Headlines that start with a count of things."""
    return headline.rlike(r"^\s*\d{1,2}\s+\w")


def listicle_penalty(score: Column, headline: Column, factor: float = 0.6) -> Column:
    return F.round(F.when(is_listicle(headline), score * factor).otherwise(score), 3)


def percent_change(now: Column, before: Column) -> Column:
    """Null where there is nothing to compare with."""
    return F.when(before.isNotNull() & (before != 0), F.round((now - before) / before * 100, 2))
