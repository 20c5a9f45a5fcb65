"""What moves: momentum of mentions, sentiment by category, signals with evidence, and alerts from thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import display_text
from tidewire.operators.articles import at, mentioned_by, mentions, originals, since
from tidewire.operators.reviews import growth, theme_windows, windowed_themes
from tidewire.plans.catalog import Catalog
from tidewire.storage.folder import written

#: Columns that all detectors of alerts give.
ALERT = ("detector", "key", "severity", "value", "previous", "evidence", "category", "region", "airline")


def _enriched(cat: Catalog) -> DataFrame:
    return originals(cat.articles).join(cat.enrichment, F.col("id") == F.col("article_id")).drop("article_id")


def _windows(as_of: str, days: int) -> tuple[Column, Column]:
    """Whether an article was published in the current window, or in the one before of equal length."""
    day = F.col("published_at")
    current = (day >= since(as_of, days)) & (day < at(as_of))
    return current, (day >= since(as_of, 2 * days)) & (day < since(as_of, days))


def momentum(cat: Catalog, as_of: str, days: int, limit: int = 10) -> DataFrame:
    """code, current, previous, delta of the carriers whose mentions moved most; both windows in one pass."""
    current, previous = _windows(as_of, days)
    rows = originals(cat.articles).filter(current | previous).select("id", "published_at")
    found = mentions(cat, "airline").select("article_id", F.coalesce("code", "name").alias("code"))
    counted = rows.join(found, F.col("id") == F.col("article_id")).groupBy("code").agg(F.count_if(current).alias("current"), F.count_if(previous).alias("previous"))
    moved = counted.withColumn("delta", F.col("current") - F.col("previous"))
    return moved.orderBy(F.abs("delta").desc(), F.col("current").desc(), "code").limit(limit)


def sentiment_by_category(cat: Catalog, as_of: str, days: int) -> DataFrame:
    rows = _enriched(cat).filter(F.col("published_at") >= since(as_of, days))
    count = lambda s: F.count_if(F.col("sentiment") == s).alias(s)
    return rows.groupBy("category").agg(count("positive"), count("neutral"), count("negative"))


def with_evidence(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, n and evidence (ids of the newest ``most``) of each group; only those few are gathered, whatever a group's size."""
    newest = Window.partitionBy(key).orderBy(F.col("published_at").desc(), "id")
    top = rows.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= most)
    lists = top.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "id"))), lambda x: x["id"]).alias("evidence"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(lists, F.col(key).eqNullSafe(F.col("_key"))).select(key, "n", "evidence")


def route_signals(cat: Catalog, as_of: str, days: int, category: str, per_region: int = 6) -> DataFrame:
    """region, n, evidence of the articles of a category."""
    rows = _enriched(cat).filter((F.col("published_at") >= since(as_of, days)) & (F.col("category") == category) & F.col("region").isNotNull())
    return with_evidence(rows.select("region", "id", "published_at"), "region", per_region)


def comparable(cat: Catalog, as_of: str, days: int, share: float = 0.35) -> DataFrame:
    """One row: articles of both windows and whether the earlier is large enough to compare with."""
    current, previous = _windows(as_of, days)
    rows = originals(cat.articles).filter(current | previous)
    return rows.agg(F.count_if(current).alias("current"), F.count_if(previous).alias("previous")).withColumn("comparable", (F.col("current") > 0) & (F.col("previous") / F.col("current") >= share))


def _alert(detector: str, key: str, severity: Column, value: Column, previous: Column, **of: str | Column) -> list[Column]:
    """Columns of an alert; ``of`` says which category, region or airline it is about, if any."""
    about = [(F.lit(of.get(d)) if not isinstance(of.get(d), Column) else of[d]).cast("string").alias(d) for d in ALERT[-3:]]
    return [F.lit(detector).alias("detector"), F.col(key).cast("string").alias("key"), severity.alias("severity"), value.cast("long").alias("value"), previous.cast("long").alias("previous"), F.col("evidence"), *about]


def surges(cat: Catalog, as_of: str, days: int, category: str) -> DataFrame:
    """Regions with three articles of a category or more, and twice as many as before."""
    current, previous = _windows(as_of, days)
    rows = _enriched(cat).filter((F.col("category") == category) & F.col("region").isNotNull() & (current | previous))
    before = rows.filter(previous).groupBy(F.col("region").alias("_r")).agg(F.count("*").alias("before"))
    now = with_evidence(rows.filter(current).select("region", "id", "published_at"), "region")
    both = now.join(before, F.col("region") == F.col("_r"), "left").withColumn("before", F.coalesce("before", F.lit(0)))
    both = both.filter((F.col("n") >= 3) & ((F.col("before") == 0) | (F.col("n") >= 2 * F.col("before"))))
    return both.select(*_alert("surge", "region", F.when(F.col("n") >= 6, "high").otherwise("medium"), F.col("n"), F.col("before"), category=category, region=F.col("region")))


def negative_clusters(cat: Catalog, as_of: str, days: int, exempt: tuple[str, ...] = ("safety",)) -> DataFrame:
    """Categories of five articles or more, half of them or more negative."""
    rows = _enriched(cat).filter((F.col("published_at") >= since(as_of, days)) & (F.col("published_at") < at(as_of)) & ~F.col("category").isin(*exempt))
    n = rows.groupBy(F.col("category").alias("_c")).agg(F.count("*").alias("all"))
    bad = with_evidence(rows.filter("sentiment = 'negative'").select("category", "id", "published_at"), "category")
    both = bad.join(n, F.col("category") == F.col("_c")).filter((F.col("all") >= 5) & (F.col("n") / F.col("all") >= 0.5))
    return both.select(*_alert("negative", "category", F.when(F.col("n") / F.col("all") >= 0.7, "high").otherwise("medium"), F.col("n"), F.col("all"), category=F.col("category")))


def rival_promotions(cat: Catalog, as_of: str, days: int, category: str, home: str) -> DataFrame:
    """Carriers other than the home carrier with two articles of a category or more."""
    rows = _enriched(cat).filter((F.col("published_at") >= since(as_of, days)) & (F.col("published_at") < at(as_of)) & (F.col("category") == category)).select("id", "published_at")
    found = mentions(cat, "airline").filter(F.upper("code") != home.upper()).select("article_id", "code").distinct()
    groups = with_evidence(rows.join(found, F.col("id") == F.col("article_id")).select("code", "id", "published_at"), "code").filter("n >= 2")
    return groups.select(*_alert("promotion", "code", F.when(F.col("n") >= 3, "high").otherwise("medium"), F.col("n"), F.lit(None), category=category, airline=F.col("code")))


def movers(cat: Catalog, as_of: str, days: int, top: int = 3) -> DataFrame:
    """The leading movers, where the windows can be compared; the evidence is of the current window."""
    moved = momentum(cat, as_of, days, 12).filter((F.abs("delta") >= 3) & (F.greatest("current", "previous") >= 3))
    moved = moved.orderBy(F.abs("delta").desc(), F.col("current").desc(), "code").limit(top)
    moved = moved.crossJoin(comparable(cat, as_of, days).select("comparable")).filter("comparable")  # one row
    current, _ = _windows(as_of, days)
    rows = originals(cat.articles).filter(current).select("id", "published_at")
    found = mentions(cat, "airline").select("article_id", F.coalesce("code", "name").alias("code")).join(moved.select("code"), "code", "left_semi").distinct()
    proof = with_evidence(rows.join(found, F.col("id") == F.col("article_id")).select("code", "id", "published_at"), "code").select(F.col("code").alias("_code"), "evidence")
    return moved.join(proof, F.col("code") == F.col("_code")).select(*_alert("momentum", "code", F.when(F.abs("delta") >= 5, "high").otherwise("medium"), F.col("current"), F.col("previous"), airline=F.col("code")))


def upcoming(cat: Catalog, today: str, days: int = 14, types: tuple[str, ...] = ("airshow", "conference", "holiday"), most: int = 4) -> DataFrame:
    """The next events, as alerts without articles."""
    first = F.lit(today).cast("date")
    rows = cat.calendar.filter(F.col("event_type").isin(*types) & F.col("starts").between(first, F.date_add(first, days))).orderBy("starts", "id").limit(most)
    rows = rows.withColumn("evidence", F.array("id"))
    return rows.select(*_alert("event", "id", F.when(F.date_diff("starts", first) <= 7, "medium").otherwise("low"), F.date_diff("starts", first), F.lit(None), region=F.col("region")))


def review_alerts(reviews: DataFrame, keywords: Mapping[str, Sequence[str]], today: str, days: int, home: str) -> DataFrame:
    """Themes that grow in the reviews of the home carrier, over windows four times as long, with their newest reviews."""
    current, _ = theme_windows(today, 4 * days)
    tagged = written(windowed_themes(reviews, keywords, today, 4 * days), "themes")  # texts are read once
    rows = tagged.filter(current).select("id", F.col("review_date").alias("published_at"), "theme")
    grown = growth(tagged, today, 4 * days).withColumnRenamed("theme", "_theme")
    both = grown.join(with_evidence(rows, "theme"), F.col("_theme") == F.col("theme"))
    return both.select(*_alert("review_theme", "theme", F.col("severity"), F.col("current"), F.col("previous"), airline=home))


def narrowed(found: DataFrame, wanted: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Alerts about one of the wanted categories, regions or airlines, whatever the case of a code; what has no such dimension goes."""
    for dimension, values in wanted.items():
        if dimension not in ALERT[-3:]:
            raise ValueError(f"alerts have no dimension {dimension!r}")
        if values:
            found = found.filter(F.upper("airline").isin([v.upper() for v in values]) if dimension == "airline" else F.col(dimension).isin(list(values)))
    return found


def recent(cat: Catalog, as_of: str, days: int) -> Catalog:
    """``cat`` with the originals of both windows alone, their enrichment and mentions of carriers, made once for all detectors."""
    current, previous = _windows(as_of, days)
    out = copy(cat)
    out.articles = written(originals(cat.articles).filter(current | previous), "recent-articles")
    within = out.articles.select(F.col("id").alias("_within"))
    out.enrichment = written(cat.enrichment.join(within, F.col("article_id") == F.col("_within"), "left_semi"), "recent-enrichment")
    carriers = cat.entities.filter("entity_type = 'airline'").select(F.col("id").alias("_wanted"))
    named = cat.article_entities.join(carriers, F.col("entity_id") == F.col("_wanted"), "left_semi")
    out.article_entities = written(mentioned_by(named, out.articles), "recent-mentions")
    return out


def alerts(
    cat: Catalog, as_of: str, days: int, category: str, home: str, limit: int = 20, *, themes: Mapping[str, Sequence[str]] | None = None, reviews: DataFrame | None = None, today: str | None = None, wanted: Mapping[str, Sequence[str] | None] | None = None
) -> DataFrame:
    """All detectors' alerts that have evidence, the most severe first; ``themes`` adds those of the reviews, ``wanted`` (values by category, region or airline) narrows."""
    whole, cat = cat, recent(cat, as_of, days)
    parts = [rival_promotions(cat, as_of, days, category, home), surges(cat, as_of, days, category), movers(cat, as_of, days), negative_clusters(cat, as_of, days)]
    if themes:
        parts.append(review_alerts(whole.reviews if reviews is None else reviews, themes, today or as_of[:10], days, home))
    parts.append(upcoming(whole, as_of[:10]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return narrowed(out, wanted or {}).filter(F.size("evidence") > 0).orderBy(rank, F.size("evidence").desc(), "detector", "key").limit(limit)


def headline() -> Column:
    """What a listing shows: the translated headline, else the original one, else the title."""
    return display_text(F.col("headline_tr"), F.col("headline"), F.col("title"))


# The sentences of a digest that no model writes.
RISING, BUSIEST, WORLDWIDE, QUIET = "Bu hafta gündemi yükselenler: ", "Yeni hat duyurularının en yoğun olduğu bölge: ", "küresel", "Bu hafta belirgin bir örüntü öne çıkmadı."


def digest(moved: DataFrame, signals: DataFrame, most: int = 3) -> DataFrame:
    """One row, text: the leading risers of ``moved`` (as ``momentum`` gives them) and the busiest region of ``signals`` (region, n)."""
    said = F.concat("code", F.lit(" ("), F.col("previous").cast("string"), F.lit("→"), F.col("current").cast("string"), F.lit(" haber)"))
    rising = moved.filter("delta > 0").select((-F.abs("delta")).alias("d"), (-F.col("current")).alias("c"), "code", said.alias("said")).orderBy("d", "c", "code").limit(most)
    names = rising.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "c", "code", "said"))), lambda x: x["said"]), ", ").alias("names"))
    top = signals.agg(F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("region", F.lit(WORLDWIDE)).alias("region"))).alias("top"))
    first = F.when(F.col("names") != "", F.concat(F.lit(RISING), "names", F.lit(".")))
    second = F.when(F.col("top").isNotNull(), F.concat(F.lit(BUSIEST), F.col("top.region"), F.lit(" ("), (-F.col("top.n")).cast("string"), F.lit(" haber).")))
    return names.crossJoin(top).select(F.coalesce(F.nullif(F.concat_ws(" ", first, second), F.lit("")), F.lit(QUIET)).alias("text"))  # one row each


def latest_digests(stored: DataFrame) -> DataFrame:
    """topic, day, body: of the stored digests (day, topic, body; one a day and topic) each topic's newest."""
    newest = stored.groupBy("topic").agg(F.max(F.struct("day", "body")).alias("x"))
    return newest.select("topic", "x.day", "x.body")
