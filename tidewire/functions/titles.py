"""Whether two titles tell one story, and whether a review's excerpt is fit to quote, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import differ_only_by_number, normalize, squash, strip_publisher, title_similarity

# Makers whose names tell stories apart, acronyms that name no party, and the similarity that merges.
MAKERS = ("airbus", "boeing", "embraer", "bombardier", "atr", "comac")
GENERIC_ACRONYMS = ("MRO", "CEO", "COO", "CFO", "AI", "IT", "US", "USA", "UK", "EU", "UAE", "NDC", "GDS", "IATA", "ICAO", "FAA", "EASA", "SAF", "ESG", "VIP", "FIA")
MODEL, ACRONYM = r"\b[a-z]?\d[\w-]*\b", r"\b[A-Z]{2,}\b"
SAME_STORY = 0.30

# The least length of an excerpt, what a chatbot's draft says, and words of software and of flights.
LEAST_CHARS = 25
CHATBOT = r"here'?s a draft|in your voice|as an ai|as an? language model|sure,? here'?s|rewrite this review"
SOFTWARE = "app|apps|application|website|site|web|login|log in|sign in|password|update|updates|bug|bugs|crash|crashes|glitch|interface|ui|ux|uygulama"
FLIGHT = (
    "flight|flights|flew|fly|flying|flown|crew|cabin|onboard|on board|board|boarding|seat|seats|meal|meals|food|catering|luggage|baggage|lounge|airport|"
    "aircraft|plane|pilot|attendant|attendants|legroom|transit|layover|stopover|business class|economy|uçuş|uçak|kabin|koltuk"
)


def disjoint(a: Column, b: Column) -> Column:
    """Whether two arrays have something each, and nothing in common."""
    # made once each: an expression that is named twice in an array function is worked out twice
    both = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: (F.size(x["a"]) > 0) & (F.size(x["b"]) > 0) & ~F.arrays_overlap(x["a"], x["b"]))
    return F.get(both, F.lit(0))


def makers(title: Column) -> Column:
    # as a lambda's variable the normal form is made once, not for each maker
    return F.get(F.transform(F.array(normalize(title)), lambda t: F.filter(F.array(*map(F.lit, MAKERS)), lambda m: F.contains(t, m))), F.lit(0))


def models(title: Column) -> Column:
    return F.regexp_extract_all(normalize(title), F.lit(MODEL), F.lit(0))


def parties(title: Column) -> Column:
    """Acronyms that say who a story is about, without the publisher's credit."""
    # a title without an acronym names nobody, whatever its credit
    some = F.coalesce(title, F.lit(""))
    found = F.regexp_extract_all(strip_publisher(some, F.lit("")), F.lit(ACRONYM), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(some.rlike(ACRONYM), F.array_except(found, F.array(*map(F.lit, GENERIC_ACRONYMS)))).otherwise(none)


def conflict(a: Column, b: Column) -> Column:
    """Whether titles name different makers, models or parties."""
    return disjoint(makers(a), makers(b)) | disjoint(models(a), models(b)) | disjoint(parties(a), parties(b))


def best_similarity(a: Column, b: Column, a_tr: Column, b_tr: Column) -> Column:
    """The greater similarity of two titles and of their translations, where both have one."""
    return F.greatest(title_similarity(a, b), F.when((a_tr != "") & (b_tr != ""), title_similarity(a_tr, b_tr)).otherwise(0.0))


def same_story(a: Column, b: Column, a_tr: Column, b_tr: Column) -> Column:
    return (best_similarity(a, b, a_tr, b_tr) >= SAME_STORY) & ~differ_only_by_number(a, b) & ~conflict(a, b)


def quotable(excerpt: Column) -> Column:
    """Long enough for an opinion, not a chatbot's draft, and not about software alone."""
    text = F.coalesce(excerpt, F.lit(""))
    says = lambda words: text.rlike(rf"(?iuU)\b(?:{words})\b")
    return (F.length(squash(text)) >= LEAST_CHARS) & ~says(CHATBOT) & ~(says(SOFTWARE) & ~says(FLIGHT))
