"""The registered queries over the relational model, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import scoring, text, titles
from tidewire.operators import articles, dedup, delivery, edition, enrich, graph, insights, merge, months, pivot, reviews, series, summary, upkeep
from tidewire.plans.catalog import Catalog, with_views
from tidewire.sources import feeds

#: "Now" of the registered queries: just after the last article, and the last reading.
AS_OF, REVIEW_DAY = "2001-08-02", "2024-10-01"
#: Keywords of the invented texts' themes.
THEMES = {"crew": ["that", "with"], "food": ["tion", "ble"], "cabin": ["thon", "ther"], "time": ["thre", "erin"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of the catalog; ``sql`` follows the named views, or stands alone where there are none."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


# --- listings and counts

_ORIGINAL = ", a AS (SELECT * FROM articles WHERE NOT is_duplicate), ae AS (SELECT * FROM a JOIN enrichment e ON a.id = e.article_id)"
_ALL = _ORIGINAL.replace("a JOIN enrichment", "a LEFT JOIN enrichment")
_AE = ("articles", "enrichment")
_MENTION = ", m AS (SELECT DISTINCT x.article_id, n.code, n.name FROM article_entities x JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = '{}')"


@query(_ORIGINAL + " SELECT id, category, published_at, headline FROM ae WHERE category = 'urgent' ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 30 OFFSET 30", *_AE)
def article_page(cat):
    return articles.newest(articles.filtered(cat, category="urgent"), 30, 30).select("id", "category", "published_at", "headline")


@query(_ORIGINAL + _MENTION.format("airline") + " SELECT id, sentiment, region FROM ae WHERE region = 'europe' AND sentiment = 'negative' AND translated_at IS NOT NULL AND id IN (SELECT article_id FROM m WHERE lower(code) IN ('a1', 'a2'))", *_AE, "article_entities", "entities")
def article_filters(cat):
    return articles.filtered(cat, region="europe", sentiment="negative", translated=True, airlines=["a1", "A2"]).select("id", "sentiment", "region")


@query(_ALL + _MENTION.format("country") + " SELECT id, category FROM ae WHERE id IN (SELECT article_id FROM m WHERE lower(name) = 'nation_14') AND coalesce(published_at, fetched_at) >= TIMESTAMP '1996-06-25' AND coalesce(published_at, fetched_at) < TIMESTAMP '1996-06-26'", *_AE, "article_entities", "entities")
def articles_on_date_by_country(cat):
    return articles.filtered(cat, country="NATION_14", on_date=dt.date(1996, 6, 25)).select("id", "category")


@query(_ORIGINAL + " SELECT category, count(*) AS n FROM ae WHERE published_at >= TIMESTAMP '2001-07-03' GROUP BY category", *_AE)
def category_counts(cat):
    return articles.count_by_category(cat, as_of=AS_OF, days=30)


@query(", a AS (SELECT * FROM articles WHERE NOT is_duplicate) SELECT d::DATE AS day, count(a.id) AS n FROM generate_series(DATE '2001-07-20', DATE '2001-08-02', INTERVAL 1 DAY) g(d) LEFT JOIN a ON CAST(coalesce(published_at, fetched_at) AS DATE) = d::DATE GROUP BY 1", "articles")
def daily_counts(cat):
    return articles.count_by_day(cat, AS_OF, 14)


@query(_ORIGINAL + ", r AS (SELECT category, date_trunc('week', published_at)::DATE AS week FROM ae WHERE published_at >= TIMESTAMP '2001-05-10'), c AS (SELECT week, category, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT category FROM c GROUP BY category ORDER BY sum(n) DESC, category LIMIT 3) SELECT w.week, t.category, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT week FROM c) w CROSS JOIN t LEFT JOIN c ON c.week = w.week AND c.category = t.category", *_AE)
def category_volume_by_week(cat):
    return articles.volume_by_week(cat, AS_OF, 12, 3)


@query(" SELECT status, count(*) AS n, max(fetched_at) AS last_fetched FROM articles GROUP BY status", "articles")
def admin_status(cat):
    return cat.articles.groupBy("status").agg(F.count("*").alias("n"), F.max("fetched_at").alias("last_fetched"))


@query(" SELECT id, status FROM articles a WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM enrichment e WHERE e.article_id = a.id)", *_AE)
def not_yet_enriched(cat):
    return articles.not_enriched(cat).select("id", "status")


@query(", p AS (SELECT * FROM articles a WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM enrichment e WHERE e.article_id = a.id)), x AS (SELECT id FROM p ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 20), y AS (SELECT id FROM p ORDER BY fetched_at, id LIMIT 7) SELECT id FROM x UNION SELECT id FROM y", *_AE)
def two_ended_selection(cat):
    return articles.two_ended(articles.not_enriched(cat), 20).select("id")


@query(", i AS (SELECT url, id FROM articles UNION ALL SELECT concat('https://new.example/', CAST(source_id AS VARCHAR)), id FROM articles) SELECT url, min(id) AS id FROM i WHERE url NOT IN (SELECT url FROM articles) GROUP BY url", "articles")
def new_urls(cat):
    # known addresses, and a new one of each source that several articles give
    incoming = cat.articles.select("url", "id").union(cat.articles.select(F.concat(F.lit("https://new.example/"), F.col("source_id").cast("string")), "id"))
    return articles.new_rows(incoming, cat.articles, "url", "id").select("url", "id")


@query(_ALL + " SELECT id, coalesce(nullif(headline_tr, ''), nullif(headline, ''), nullif(title, '')) AS shown, translated_at IS NOT NULL AS is_translated, greatest(1, round(word_count / 200.0))::BIGINT AS reading_minutes FROM ae", *_AE)
def article_cards(cat):
    return articles.filtered(cat).select("id", insights.headline().alias("shown"), F.col("translated_at").isNotNull().alias("is_translated"), text.reading_minutes(F.col("word_count")).alias("reading_minutes"))


@query(
    r", t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(body, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM reviews), w AS (SELECT id, list_filter(string_split(x, ' '), lambda y: y <> '') AS w FROM t), h AS (SELECT id, len(w) AS n, len(list_filter(w, lambda y: y = 'thon')) AS h1, len(list_filter(w, lambda y: y = 'thre')) AS h2 FROM w) SELECT id, round((h1 + h2) / (1 + ln(n)), 6) AS rank FROM h WHERE h1 > 0 AND h2 > 0",
    "reviews",
)
def full_text_search(cat):
    return articles.search(cat.reviews, "thon thre", "body", "id")


@query(_ALL + _MENTION.format("airport") + ", r AS (SELECT * FROM ae WHERE id IN (SELECT article_id FROM m WHERE lower(code) = 'h7') AND source_id IN (SELECT id FROM sources WHERE category IN ('BUILDING', 'MACHINERY'))) SELECT id, category, (SELECT count(*) FROM r) AS total FROM r ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 20", *_AE, "article_entities", "entities", "sources")
def article_page_with_total(cat):
    names = cat.sources.filter(F.col("category").isin("BUILDING", "MACHINERY")).select(F.col("id").alias("_source"))
    rows = articles.filtered(cat, airport="H7").join(names, F.col("source_id") == F.col("_source"), "left_semi")
    return articles.page_with_total(rows, 20).select("id", "category", "total")


@query(_ORIGINAL + " SELECT id, category, sentiment FROM ae WHERE category IN ('urgent', 'low') AND sentiment IN ('neutral', 'negative') AND source_id IN (SELECT id FROM sources WHERE name IN ('Customer#000000007', 'Customer#000000008', 'Customer#000000009'))", *_AE, "sources")
def articles_of_several_values(cat):
    return articles.filtered(cat, category=["urgent", "low"], sentiment=["neutral", "negative"], region=[], sources=["Customer#000000007", "Customer#000000008", "Customer#000000009"]).select("id", "category", "sentiment")


_CLIP = r"""
, c AS (SELECT id, trim(regexp_replace(coalesce(body, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS x FROM reviews),
s AS (SELECT id, x, regexp_extract(x, '^.*?[.!?](?: |$)') AS f, regexp_extract(x, '^.*?[.!?] .*?[.!?](?: |$)') AS g FROM c),
o AS (SELECT id, rtrim(CASE WHEN f <> '' THEN f ELSE x END) AS one, rtrim(CASE WHEN g <> '' THEN g ELSE x END) AS two FROM s),
k AS (SELECT id, CASE WHEN length(two) <= 280 THEN two ELSE one END AS k FROM o)
SELECT id, CASE WHEN length(k) <= 280 THEN k ELSE concat(regexp_replace(regexp_replace(k[1:279], '\s\S*$', ''), '[ ,;:\-]+$', ''), '…') END AS excerpt FROM k"""


@query(_CLIP, "reviews")
def review_excerpts(cat):
    return cat.reviews.select("id", text.clip_excerpt(F.col("body")).alias("excerpt"))


@query(r" SELECT id, len(regexp_extract_all(coalesce(body, ''), '[^ \t\n\x0b\f\r]+'))::BIGINT AS words, length(coalesce(body, ''))::BIGINT AS chars, sha256(concat(url, '|', coalesce(source_name, ''))) AS key FROM reviews", "reviews")
def review_measures(cat):
    return cat.reviews.select("id", text.word_count(F.col("body")).alias("words"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("chars"), text.dedupe_key(F.col("url"), F.coalesce("source_name", F.lit(""))).alias("key"))


# --- local enrichment

#: Keywords of the invented texts, and the weights of two categories.
TOPICS, FOCUS = {"network": ["the", "and"], "finance": ["que", "la"], "fleet": ["der", "und"], "safety": ["tion", "with"]}, {"finance": 2, "fleet": 3}
SUBTOPICS = {"network": {"hub": ["to"], "route": ["in"]}, "finance": {"debt": ["en"], "cash": ["ci"]}, "events": {"fair": ["the"]}}
COMMERCIAL, DECISIVE, WATCHED = ["that", "is", "le"], ["for", "die"], ["en la", "les"]


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _any(words: list[str]) -> str:
    return rf"'\b(?:{'|'.join(words)})\b'"


def _hits(words: list[str]) -> str:
    return f"(3 * len(regexp_extract_all(t, {_any(words)})) + len(regexp_extract_all(b, {_any(words)})))"


_SCORED = (
    f", n AS (SELECT id, rating, {_normal('substr(body, 1, 60)')} AS t, {_normal('body')} AS b, length(coalesce(body, '')) < 120 AS stub FROM reviews)"
    + ", h AS (SELECT *, " + ", ".join(f"{_hits(k)} AS {c}" for c, k in TOPICS.items()) + f", {_hits(COMMERCIAL)} AS c FROM n)"
    + ", k AS (SELECT *, greatest(network, 2 * finance, 3 * fleet, safety) AS best FROM h)"
    + ", r AS (SELECT *, CASE WHEN best = 0 THEN 'general' WHEN network = best THEN 'network' WHEN 2 * finance = best THEN 'finance' WHEN 3 * fleet = best THEN 'fleet' ELSE 'safety' END AS category FROM k)"
)


def _relevance(cat: Catalog) -> DataFrame:
    rows = cat.reviews.select("id", F.substring("body", 1, 60).alias("title"), "body")
    return enrich.relevance(rows, TOPICS, FOCUS, COMMERCIAL, DECISIVE, WATCHED)


@query(_SCORED + f" SELECT id, category, (best + c + CASE WHEN regexp_matches(t, {_any(DECISIVE)}) THEN 6 ELSE 0 END + CASE WHEN regexp_matches(t, {_any(WATCHED)}) THEN 6 ELSE 0 END + CASE WHEN stub AND c > 0 THEN 3 ELSE 0 END)::BIGINT AS score FROM r", "reviews")
def relevance_scores(cat):
    return _relevance(cat).select("id", "category", "score")


_SUB = " ".join(f"WHEN category = '{c}' THEN CASE WHEN {_hits(x[0])} = 0 AND {_hits(y[0])} = 0 THEN NULL WHEN {_hits(x[0])} >= {_hits(y[0])} THEN '{x[1]}' ELSE '{y[1]}' END" for c, x, y in (("network", (["to"], "hub"), (["in"], "route")), ("finance", (["en"], "debt"), (["ci"], "cash"))))


@query(_SCORED + f" SELECT id, CASE {_SUB} END AS subcategory FROM r", "reviews")
def subcategories(cat):
    return _relevance(cat).select("id", enrich.subcategory(F.col("title"), F.col("body"), F.col("category"), SUBTOPICS).alias("subcategory"))


@query(
    _SCORED + ", o AS (SELECT id, CASE WHEN rating >= 5 THEN 'network' ELSE 'safety' END AS chosen, unnest([{'c': 'network', 's': network}, {'c': 'finance', 's': finance}, {'c': 'fleet', 's': fleet}, {'c': 'safety', 's': safety}], recursive := true) FROM r)"
    ", p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS nth, lead(s) OVER (PARTITION BY id ORDER BY s DESC) AS second, max(CASE WHEN c = chosen THEN s END) OVER (PARTITION BY id) AS own FROM o)"
    " SELECT id, CASE WHEN s > second AND s >= 3 AND s - own >= 2 THEN c END AS instead FROM p WHERE nth = 1",
    "reviews",
)
def category_overrides(cat):
    chosen = cat.reviews.select(F.col("id").alias("_id"), F.when(F.col("rating") >= 5, "network").otherwise("safety").alias("chosen"))
    return _relevance(cat).join(chosen, F.col("id") == F.col("_id")).select("id", enrich.overruled(F.col("chosen"), F.col("raw")).alias("instead"))


_FOUND = f", n AS (SELECT id, {_normal('body')} AS b FROM reviews), f AS (SELECT n.id, entity_type, name, arg_min(code, ord) AS code, min(ord)::INT AS ord FROM n JOIN gazetteer g ON contains(concat(' ', b, ' '), concat(' ', g.alias, ' ')) GROUP BY ALL)"


@query(_FOUND + " SELECT * FROM f", "reviews", "gazetteer")
def text_entities(cat):
    return enrich.entities(cat.reviews, cat.view("gazetteer"), "body")


@query(
    _FOUND + ", c(country, region) AS (VALUES ('und', 'europe'), ('spain', 'iberia')), p(code, country) AS (VALUES ('DRF', 'und'), ('LAF', 'spain'))"
    ", x AS (SELECT id, lower(name) AS country, 0 AS tier, ord FROM f WHERE entity_type = 'country' UNION ALL SELECT id, country, 1, ord FROM f JOIN p ON f.code = p.code WHERE entity_type = 'airport')"
    " SELECT id, arg_min(region, tier * 100 + ord) AS region FROM x JOIN c ON x.country = c.country GROUP BY id",
    "reviews", "gazetteer",
)
def text_regions(cat):
    country_regions = cat.spark.createDataFrame([("und", "europe"), ("spain", "iberia")], "country string, region string")
    airports = cat.spark.createDataFrame([("DRF", "und"), ("LAF", "spain")], "code string, country string")
    return enrich.regions(enrich.entities(cat.reviews, cat.view("gazetteer"), "body"), country_regions, airports)


_WORD = r"[^\p{L}\p{M}\p{N}_]"


def _says(words: str) -> str:
    words = words.replace("'", "''")
    return f"regexp_matches(coalesce(body, ''), '(?i)(?:^|{_WORD})(?:{words})(?:$|{_WORD})')"


@query(rf" SELECT id, length(regexp_replace(lower(coalesce(body, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g')) >= 25 AND NOT {_says(titles.CHATBOT)} AND NOT ({_says(titles.SOFTWARE)} AND NOT {_says(titles.FLIGHT)}) AS quotable FROM reviews", "reviews")
def quotable_reviews(cat):
    return cat.reviews.select("id", titles.quotable(F.col("body")).alias("quotable"))


# --- pivots


def _pivot_sql(row: str, col: str | None, value: str, joins: str = "", where: str = "") -> str:
    cube, flags = (f"CUBE (({row}), ({col}))", f"grouping({col})::INT") if col else (f"ROLLUP (({row}))", "1")
    return f" SELECT {row} AS row, {col or 'NULL'}{'' if col else '::VARCHAR'} AS col, grouping({row})::INT AS row_total, {flags} AS col_total, {value} AS value FROM r GROUP BY {cube}"


_PIVOT_BASE = ", r AS (SELECT a.*, e.*, s.name AS source_name, strftime(coalesce(published_at, fetched_at), '%Y-%m') AS month FROM articles a LEFT JOIN enrichment e ON a.id = e.article_id LEFT JOIN sources s ON a.source_id = s.id WHERE NOT is_duplicate)"
_PV = ("articles", "enrichment", "sources")


@query(_PIVOT_BASE + _pivot_sql("category", "sentiment", "count(*)::DOUBLE"), *_PV)
def pivot_count(cat):
    return pivot.pivot(cat, "category", "sentiment")


@query(_PIVOT_BASE + _pivot_sql("region", "category", "count(DISTINCT source_id)::DOUBLE"), *_PV)
def pivot_sources(cat):
    return pivot.pivot(cat, "region", "category", "sources")


@query(_PIVOT_BASE + _pivot_sql("subcategory", None, "round(avg(importance_score), 3)"), *_PV)
def pivot_importance(cat):
    return pivot.pivot(cat, "subcategory", None, "importance")


@query(_PIVOT_BASE + _pivot_sql("month", "sentiment", "sum(corroborating_source_count)::DOUBLE"), *_PV)
def pivot_months(cat):
    return pivot.pivot(cat, "month", "sentiment", "corroboration")


@query(_MENTION.format("airline") + ", r AS (SELECT m.name AS airline, e.sentiment FROM articles a LEFT JOIN enrichment e ON a.id = e.article_id LEFT JOIN m ON a.id = m.article_id WHERE NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02' AND e.category = 'high')" + _pivot_sql("airline", "sentiment", "count(*)::DOUBLE"), *_PV, "article_entities", "entities")
def pivot_airlines(cat):
    return pivot.pivot(cat, "airline", "sentiment", as_of=AS_OF, days=365, category="high")


@query(_PIVOT_BASE + ", c AS (" + _pivot_sql("month", "region", "count(*)::DOUBLE") + "), x AS (SELECT row FROM c WHERE row_total = 0 AND col_total = 1 ORDER BY row NULLS LAST LIMIT 12), y AS (SELECT col FROM c WHERE row_total = 1 AND col_total = 0 ORDER BY value DESC NULLS LAST, col NULLS LAST LIMIT 3) SELECT * FROM c WHERE (row_total = 1 OR EXISTS (SELECT 1 FROM x WHERE x.row IS NOT DISTINCT FROM c.row)) AND (col_total = 1 OR EXISTS (SELECT 1 FROM y WHERE y.col IS NOT DISTINCT FROM c.col))", *_PV)
def pivot_truncated(cat):
    return pivot.truncated(pivot.pivot(cat, "month", "region"), "month", 12, 3, "region")


@query(" SELECT count(*)::DOUBLE AS value FROM articles WHERE NOT is_duplicate AND published_at > TIMESTAMP '2050-01-01'", "articles")
def pivot_empty_total(cat):
    return pivot.grand_total(pivot.pivot(cat, "category", "sentiment", as_of="2060-01-01", days=1))


# --- metric series

_K = ", p AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY as_of DESC, id DESC) AS nth, lag(value) OVER (PARTITION BY metric_key ORDER BY as_of, id) AS previous FROM kpis WHERE is_primary)"


@query(_K + " SELECT metric_key, id, value, as_of FROM p WHERE nth <= 12", "kpis")
def kpi_trends(cat):
    return series.trends(cat.kpis).select("metric_key", "id", "value", "as_of")


@query(_K + " SELECT metric_key, as_of, value, previous, CASE WHEN previous <> 0 THEN round((value - previous) / previous * 100, 2) END AS change FROM p WHERE nth = 1", "kpis")
def kpi_dashboard(cat):
    return series.dashboard(cat.kpis)


@query(_K + ", y AS (SELECT metric_key, arg_max(value, (as_of, id)) AS ly FROM kpis WHERE is_primary AND as_of < TIMESTAMP '2024-01-15' GROUP BY metric_key) SELECT p.metric_key, value, ly AS ly_value, CASE WHEN ly <> 0 THEN round((value - ly) / ly * 100, 2) END AS ly_change FROM p JOIN y USING (metric_key) WHERE nth = 1", "kpis")
def kpi_against_last_year(cat):
    # the invented readings are of one month; its first half stands for last year
    moved = cat.kpis.withColumn("as_of", F.when(F.col("as_of") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("as_of") - F.expr("INTERVAL 1 YEAR")).otherwise(F.col("as_of")))
    return series.against_last_year(moved, 2023)


@query(", l AS (SELECT * FROM kpis WHERE metric_key = 'purchase' AND NOT is_primary ORDER BY as_of DESC, id DESC LIMIT 5), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY as_of DESC, id DESC) AS nth FROM l) SELECT id, source, value FROM s WHERE nth = 1", "kpis")
def kpi_corroborations(cat):
    return series.corroborations(cat.kpis, "purchase").select("id", "source", "value")


_ROUNDED = "SELECT * REPLACE (round(value / 50) AS value, concat('s', CAST(id // 40 AS VARCHAR)) AS source) FROM kpis"


def _coarse(cat):
    return cat.kpis.withColumns({"value": F.round(F.col("value") / 50), "source": F.concat(F.lit("s"), F.floor(F.col("id") / 40).cast("string"))})


@query(f", k AS ({_ROUNDED}), l AS (SELECT *, lag(value) OVER w AS v, lag(source) OVER w AS s, row_number() OVER w AS nth FROM k WINDOW w AS (PARTITION BY metric_key ORDER BY as_of, id)) SELECT id, metric_key, value FROM l WHERE nth = 1 OR v IS DISTINCT FROM value OR s IS DISTINCT FROM source", "kpis")
def kpi_without_repeats(cat):
    return series.without_repeats(_coarse(cat)).select("id", "metric_key", "value")


@query(f", k AS ({_ROUNDED}), l AS (SELECT metric_key, arg_max(value, (as_of, id)) AS v, arg_max(source, (as_of, id)) AS s FROM k GROUP BY metric_key) SELECT id, k.metric_key, value FROM k LEFT JOIN l USING (metric_key) WHERE (l.metric_key IS NULL OR v IS DISTINCT FROM value OR s IS DISTINCT FROM source)", "kpis")
def kpi_changed(cat):
    rows = _coarse(cat)
    return series.changed(rows, rows).select("id", "metric_key", "value")


@query(" SELECT as_of::DATE AS date, value, unit, source, coalesce(source_url, '') AS source_url FROM kpis WHERE metric_key = 'click' AND is_primary", "kpis")
def kpi_export(cat):
    return series.for_export(cat.kpis, "click")


# --- insights and alerts

_WIN = "published_at >= TIMESTAMP '2001-05-04' AND published_at < TIMESTAMP '2001-08-02'"
_BEFORE = "published_at >= TIMESTAMP '2001-02-03' AND published_at < TIMESTAMP '2001-05-04'"


@query(_MENTION.format("airline").replace("DISTINCT x.article_id, ", "x.article_id, ") + f", c AS (SELECT code, count(*) FILTER ({_WIN}) AS current, count(*) FILTER ({_BEFORE}) AS previous FROM articles a JOIN m ON a.id = m.article_id WHERE NOT is_duplicate AND ({_WIN} OR {_BEFORE}) GROUP BY code) SELECT *, current - previous AS delta FROM c ORDER BY abs(delta) DESC, current DESC, code LIMIT 10", "articles", "article_entities", "entities")
def airline_momentum(cat):
    return insights.momentum(cat, AS_OF, 90)


@query(_ORIGINAL + " SELECT category, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM ae WHERE published_at >= TIMESTAMP '2000-08-02' GROUP BY category", *_AE)
def sentiment_by_category(cat):
    return insights.sentiment_by_category(cat, AS_OF, 365)


@query(_ORIGINAL + ", x AS (SELECT region, id, row_number() OVER (PARTITION BY region ORDER BY published_at DESC, id) AS nth FROM ae WHERE published_at >= TIMESTAMP '2000-08-02' AND category = 'low' AND region IS NOT NULL) SELECT region, count(*) AS n, list(id ORDER BY nth) FILTER (nth <= 6) AS evidence FROM x GROUP BY region", *_AE)
def new_route_signals(cat):
    return insights.route_signals(cat, AS_OF, 365, "low")


@query(f" SELECT count(*) FILTER ({_WIN}) AS current, count(*) FILTER ({_BEFORE}) AS previous, count(*) FILTER ({_WIN}) > 0 AND count(*) FILTER ({_BEFORE}) / count(*) FILTER ({_WIN}) >= 0.35 AS comparable FROM articles WHERE NOT is_duplicate", "articles")
def comparable_windows(cat):
    return insights.comparable(cat, AS_OF, 90)




@query(
    _MENTION.format("airline").replace("DISTINCT x.article_id, ", "x.article_id, ") + f", c AS (SELECT code, count(*) FILTER ({_WIN}) AS current, count(*) FILTER ({_BEFORE}) AS previous FROM articles a JOIN m ON a.id = m.article_id WHERE NOT is_duplicate AND ({_WIN} OR {_BEFORE}) GROUP BY code), d AS (SELECT * FROM c ORDER BY abs(current - previous) DESC, current DESC, code LIMIT 10), u AS (SELECT * FROM d WHERE current > previous ORDER BY current - previous DESC, current DESC, code LIMIT 3)"
    f", g AS (SELECT region, count(*) AS n FROM articles a JOIN enrichment e ON a.id = e.article_id WHERE NOT is_duplicate AND published_at >= TIMESTAMP '2000-08-02' AND category = 'low' AND region IS NOT NULL GROUP BY region ORDER BY n DESC, region LIMIT 1), p AS (SELECT (SELECT concat('{insights.RISING}', string_agg(concat(code, ' (', previous, '→', current, ' haber)'), ', ' ORDER BY current - previous DESC, current DESC, code), '.') FROM u HAVING count(*) > 0) AS a, (SELECT concat('{insights.BUSIEST}', region, ' (', n, ' haber).') FROM g) AS b) SELECT coalesce(nullif(concat_ws(' ', a, b), ''), '{insights.QUIET}') AS text FROM p",
    *_AE, "article_entities", "entities",
)
def insight_digest(cat):
    return insights.digest(insights.momentum(cat, AS_OF, 90), insights.route_signals(cat, AS_OF, 365, "low"))


# --- places


@query(", m AS (SELECT DISTINCT x.article_id, n.code FROM article_entities x JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'airport'), c AS (SELECT code, count(*) AS n FROM articles a JOIN m ON a.id = m.article_id WHERE NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02' GROUP BY code) SELECT p.code AS place, coalesce(n, 0) AS n FROM (SELECT DISTINCT code FROM entities WHERE entity_type = 'airport') p LEFT JOIN c USING (code)", "articles", "article_entities", "entities")
def hub_counts(cat):
    return graph.place_counts(cat, AS_OF, 365)


@query(", m AS (SELECT DISTINCT x.article_id, n.name FROM article_entities x JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'country') SELECT name AS place, count(a.id) AS n FROM (SELECT DISTINCT name FROM entities WHERE entity_type = 'country') LEFT JOIN m USING (name) LEFT JOIN articles a ON a.id = m.article_id AND NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02' GROUP BY name", "articles", "article_entities", "entities")
def country_counts(cat):
    return graph.place_counts(cat, AS_OF, 365, "country", "name")


@query(", m AS (SELECT DISTINCT a.id, n.code FROM articles a JOIN article_entities x ON a.id = x.article_id JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'airport' AND NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02') SELECT l.code AS origin, r.code AS destination, count(*) AS n FROM m l JOIN m r ON l.id = r.id AND l.code < r.code GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, origin, destination LIMIT 40", "articles", "article_entities", "entities")
def co_mention_routes(cat):
    return graph.routes(cat, AS_OF, 365)


@query(_MENTION.format("airline").replace(", n.name", "").replace(", m AS", ", l AS") + ", r AS (SELECT a.id FROM articles a WHERE NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02' AND id IN (SELECT article_id FROM article_entities x JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'airport' AND lower(n.code) = 'h7')), k AS (SELECT code, count(*) AS n FROM r JOIN l ON r.id = l.article_id GROUP BY code ORDER BY n DESC, code LIMIT 8) SELECT 'total' AS kind, '' AS name, count(*) AS n FROM r UNION ALL SELECT 'category', category, count(*) FROM r JOIN enrichment e ON r.id = e.article_id GROUP BY category UNION ALL SELECT 'carrier', code, n FROM k", *_AE, "article_entities", "entities")
def hub_detail(cat):
    return graph.place_detail(cat, "h7", AS_OF, 365)


# --- calendar, reviews, editions


@query(" SELECT id, starts, ends FROM calendar WHERE region = 'europe' AND event_type = 'airshow' AND ends >= DATE '1998-03-01' AND starts <= DATE '1998-03-31'", "calendar")
def calendar_overlap(cat):
    rows = cat.calendar.filter("region = 'europe' and event_type = 'airshow'")
    return rows.filter((F.col("ends") >= F.lit("1998-03-01").cast("date")) & (F.col("starts") <= F.lit("1998-03-31").cast("date"))).select("id", "starts", "ends")


@query(", d AS (SELECT id, starts, unnest(generate_series(starts, ends, INTERVAL 1 DAY))::DATE AS day FROM calendar WHERE starts >= DATE '1998-03-01' AND starts < DATE '1998-04-01') SELECT day, count(*) AS n, count(*) FILTER (day = starts) AS starting FROM d GROUP BY day", "calendar")
def calendar_days(cat):
    rows = cat.calendar.filter((F.col("starts") >= F.lit("1998-03-01").cast("date")) & (F.col("starts") < F.lit("1998-04-01").cast("date")))
    days = rows.select("starts", F.explode(F.sequence("starts", "ends")).alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("day") == F.col("starts")).alias("starting"))


_SENTIMENT = "CASE WHEN rating >= 7 THEN 'positive' WHEN rating <= 4 THEN 'negative' ELSE 'neutral' END"


def _theme_sql() -> str:
    normal = r"trim(regexp_replace(regexp_replace(lower(coalesce(body, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    hits = ", ".join(f"{{'n': -len(regexp_extract_all(x, '{scoring.keyword_pattern(ws)}')), 'theme': '{t}'}}" for t, ws in THEMES.items())
    return f", x AS (SELECT id, review_date, {_SENTIMENT} AS sentiment, {normal} AS x FROM reviews), t AS (SELECT id, review_date, sentiment, unnest(list_sort(list_filter([{hits}], lambda h: h.n < 0))[1:3]).theme AS theme FROM x)"


@query(_theme_sql() + " SELECT theme, count(*) AS n, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, arg_max(id, (coalesce(review_date, DATE '0001-01-01'), id)) AS newest FROM t GROUP BY theme", "reviews")
def review_themes(cat):
    return reviews.theme_stats(cat.reviews, THEMES)


@query(f", x AS (SELECT rating, {_SENTIMENT} AS s FROM reviews) SELECT count(*) AS n, count(rating) AS rated, round(avg(rating), 1) AS mean_rating, count(*) FILTER (s = 'positive') AS positive, count(*) FILTER (s = 'neutral') AS neutral, count(*) FILTER (s = 'negative') AS negative FROM x", "reviews")
def review_stats(cat):
    return reviews.overall(cat.reviews)


@query(_theme_sql() + ", c AS (SELECT theme, count(*) FILTER (review_date >= DATE '2024-07-03') AS current, count(*) FILTER (review_date < DATE '2024-07-03') AS previous, count(*) FILTER (review_date >= DATE '2024-07-03' AND sentiment = 'negative') AS bad FROM t WHERE review_date >= DATE '2024-04-04' GROUP BY theme) SELECT theme, current, previous, CASE WHEN bad / current >= 0.6 THEN 'high' ELSE 'medium' END AS severity FROM c WHERE current >= 3 AND current >= 0.9 * previous", "reviews")
def review_theme_growth(cat):
    return reviews.theme_growth(cat.reviews, THEMES, REVIEW_DAY, 90, factor=0.9)


_NONE = "NULL::VARCHAR"


def _alerts_sql(themes: bool, wanted: str) -> str:
    """All detectors' alerts; ``themes`` adds those of reviews."""
    newest = "list(id ORDER BY published_at DESC, id)[1:5]"
    part = lambda detector, key, severity, value, previous, source, about: f"SELECT '{detector}' AS detector, {key} AS key, {severity} AS severity, ({value})::BIGINT AS value, ({previous})::BIGINT AS previous, evidence, {about} FROM {source}"
    about = lambda category=_NONE, region=_NONE, airline=_NONE: f"{category} AS category, {region} AS region, {airline} AS airline"
    parts = [
        part("promotion", "code", "CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END", "n", "NULL", "pr", about("'urgent'", airline="code")),
        part("surge", "region", "CASE WHEN n >= 6 THEN 'high' ELSE 'medium' END", "n", "prev", "su", about("'urgent'", "region")),
        part("momentum", "code", "CASE WHEN abs(current - previous) >= 5 THEN 'high' ELSE 'medium' END", "current", "previous", "mv", about(airline="code")),
        part("negative", "category", "CASE WHEN n / total >= 0.7 THEN 'high' ELSE 'medium' END", "n", "total", "ng", about("category")),
        part("event", "CAST(id AS VARCHAR)", "CASE WHEN starts - DATE '2001-08-02' <= 7 THEN 'medium' ELSE 'low' END", "starts - DATE '2001-08-02'", "NULL", "ev", about(region="region")),
    ]
    if themes:
        parts.append(part("review_theme", "theme", "CASE WHEN bad / current >= 0.6 THEN 'high' ELSE 'medium' END", "current", "previous", "rt", about(airline="'A0'")))
    return (
        _ORIGINAL + _MENTION.format("airline").replace("DISTINCT x.article_id, ", "x.article_id, ")
        + f", pr AS (SELECT code, count(*) AS n, {newest} AS evidence FROM (SELECT DISTINCT ae.id, published_at, code FROM ae JOIN m ON m.article_id = ae.id WHERE {_WIN} AND category = 'urgent' AND upper(code) <> 'A0') GROUP BY code HAVING count(*) >= 2)"
        + f", sn AS (SELECT region, count(*) FILTER ({_WIN}) AS n, count(*) FILTER ({_BEFORE}) AS prev, (list(id ORDER BY published_at DESC, id) FILTER ({_WIN}))[1:5] AS evidence FROM ae WHERE category = 'urgent' AND region IS NOT NULL GROUP BY region), su AS (SELECT * FROM sn WHERE n >= 3 AND (prev = 0 OR n >= 2 * prev))"
        + f", mc AS (SELECT coalesce(code, name) AS code, count(*) FILTER ({_WIN}) AS current, count(*) FILTER ({_BEFORE}) AS previous FROM a JOIN m ON a.id = m.article_id WHERE {_WIN} OR {_BEFORE} GROUP BY 1), mt AS (SELECT * FROM mc ORDER BY abs(current - previous) DESC, current DESC, code LIMIT 12), mm AS (SELECT * FROM mt WHERE abs(current - previous) >= 3 AND greatest(current, previous) >= 3 ORDER BY abs(current - previous) DESC, current DESC, code LIMIT 3)"
        + f", cw AS (SELECT count(*) FILTER ({_WIN}) AS c, count(*) FILTER ({_BEFORE}) AS p FROM a), me AS (SELECT code, {newest} AS evidence FROM (SELECT DISTINCT a.id, published_at, coalesce(code, name) AS code FROM a JOIN m ON m.article_id = a.id WHERE {_WIN}) GROUP BY code), mv AS (SELECT mm.*, evidence FROM mm JOIN me ON me.code = mm.code, cw WHERE c > 0 AND p / c >= 0.35)"
        + f", nc AS (SELECT category, count(*) AS total, count(*) FILTER (sentiment = 'negative') AS n, (list(id ORDER BY published_at DESC, id) FILTER (sentiment = 'negative'))[1:5] AS evidence FROM ae WHERE {_WIN} AND category <> 'safety' GROUP BY category), ng AS (SELECT * FROM nc WHERE n > 0 AND total >= 5 AND n / total >= 0.5)"
        + ", ev AS (SELECT *, [id] AS evidence FROM calendar WHERE event_type IN ('airshow', 'conference', 'holiday') AND starts BETWEEN DATE '2001-08-02' AND DATE '2001-08-16' ORDER BY starts, id LIMIT 4)"
        + (_theme_sql() + ", rc AS (SELECT theme, count(*) FILTER (review_date >= DATE '2023-10-07') AS current, count(*) FILTER (review_date < DATE '2023-10-07') AS previous, count(*) FILTER (review_date >= DATE '2023-10-07' AND sentiment = 'negative') AS bad, (list(id ORDER BY review_date DESC, id) FILTER (review_date >= DATE '2023-10-07'))[1:5] AS evidence FROM t WHERE review_date >= DATE '2022-10-12' GROUP BY theme), rt AS (SELECT * FROM rc WHERE current >= 3 AND current >= 1.5 * previous)" if themes else "")
        + f", al AS ({' UNION ALL '.join(parts)}) SELECT * FROM al WHERE len(evidence) > 0 AND {wanted} ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, len(evidence) DESC, detector, key LIMIT 20"
    )


_ALERTED = (*_AE, "article_entities", "entities", "calendar")


@query(_alerts_sql(True, "true"), *_ALERTED, "reviews")
def alerts(cat):
    return insights.alerts(cat, AS_OF, 90, "urgent", "A0", themes=THEMES, today=REVIEW_DAY)


@query(_alerts_sql(False, "category IN ('urgent', 'low')"), *_ALERTED)
def alerts_of_categories(cat):
    return insights.alerts(cat, AS_OF, 90, "urgent", "A0", wanted={"category": ["urgent", "low"]})


_EDITION = _ORIGINAL + r", r AS (SELECT article_id, category, round(CASE WHEN regexp_matches(headline, '^\s*\d{1,2}\s+\w') THEN importance_score * 0.6 ELSE importance_score END, 3) AS score FROM ae WHERE fetched_at >= TIMESTAMP '1998-06-01' AND fetched_at < TIMESTAMP '1998-06-02'), p AS (SELECT *, row_number() OVER (ORDER BY score + CASE WHEN category = 'low' THEN 0.25 ELSE 0 END DESC, score DESC, article_id) AS place FROM r), s AS (SELECT *, CASE WHEN place <= 3 THEN 'top_story' ELSE category END AS section FROM p), e AS (SELECT article_id, section, row_number() OVER (PARTITION BY section ORDER BY place) - 1 AS rank FROM s)"


@query(_EDITION + " SELECT * FROM e", *_AE)
def edition_of_day(cat):
    return edition.assemble(cat, dt.date(1998, 6, 1), focus=("low",), front=3)


@query(_EDITION + ", l AS (SELECT section FROM e WHERE section <> 'top_story' GROUP BY section ORDER BY count(*) DESC, section LIMIT 2) SELECT * FROM e WHERE section = 'top_story' AND rank <= 7 OR rank < 1 AND section IN (SELECT section FROM l)", *_AE)
def newsletter_digest(cat):
    return edition.digest(edition.assemble(cat, dt.date(1998, 6, 1), focus=("low",), front=3), links=1, sections=2)


# --- duplicates and snapshots

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PAIRS = r", w AS (SELECT id, list_filter(string_split(" + _NORMAL.format("body") + r", ' '), lambda x: x <> '') AS w FROM reviews), s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w), e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), o AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), p AS (SELECT a, b, o / (na + nb - o) AS similarity FROM o WHERE o / (na + nb - o) >= 0.5)"


@query(_PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM p", "reviews")
def near_duplicate_pairs(cat):
    found = dedup.similar_pairs(cat.reviews.select("id", F.col("body").alias("text")))
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def greedy_dedup(cat):
    return dedup.near_duplicates(cat.reviews.select("id", F.col("body").alias("text"), F.col("review_date").alias("time")))


@query(_ORIGINAL.split(", ae AS")[0] + ", g AS (SELECT DISTINCT coalesce(duplicate_of_id, id) AS g, source_id FROM articles), m AS (SELECT g, count(*) AS n, round(avg(trust_weight), 6) AS t FROM g JOIN sources s ON g.source_id = s.id GROUP BY g), c AS (SELECT a.id, n, round(least(1.0, greatest(0.0, 0.4 + 0.15 * (n - 1) + 0.3 * t)), 3) AS confidence FROM a JOIN m ON a.id = m.g) SELECT id, n AS n_sources, confidence, round(least(1.0, 0.7 * confidence + 0.06 * least(n, 5)), 3) AS importance FROM c", "articles", "sources")
def rescored(cat):
    found = dedup.corroboration(cat.articles, cat.sources)
    found = found.withColumn("confidence", scoring.confidence(F.col("n_sources"), F.col("mean_trust")))
    return found.select("id", "n_sources", "confidence", scoring.importance(F.col("confidence"), F.col("n_sources")).alias("importance"))


@query(r", x AS (SELECT id, " + _NORMAL.format("body[1:2000]") + r" AS b, " + _NORMAL.format("source_name") + r" AS t FROM reviews) SELECT id, sha256(concat(t, ' ', b)) AS hash FROM x", "reviews")
def content_hashes(cat):
    return cat.reviews.select("id", text.content_hash(F.col("source_name"), F.col("body")).alias("hash"))


@query(", i AS (SELECT id + 5 AS id, name, 'new' AS category, trust_weight, is_active FROM sources) SELECT coalesce(s.id, i.id) AS id, coalesce(s.name, i.name) AS name, coalesce(i.category, s.category) AS category, CASE WHEN s.id IS NULL THEN i.trust_weight ELSE s.trust_weight END AS trust_weight FROM sources s FULL JOIN i ON s.id = i.id", "sources")
def upserted_sources(cat):
    incoming = cat.sources.withColumns({"id": F.col("id") + 5, "category": F.lit("new")})
    return merge.upsert(cat.sources, incoming, ["id"], ["category"]).select("id", "name", "category", "trust_weight")


@query(" SELECT id, name FROM sources UNION ALL SELECT id + 5 AS id, concat(name, ' (new)') AS name FROM sources WHERE id + 5 NOT IN (SELECT id FROM sources)", "sources")
def inserted_sources(cat):
    return merge.insert_absent(cat.sources, cat.sources.withColumns({"id": F.col("id") + 5, "name": F.concat("name", F.lit(" (new)"))}), ["id"]).select("id", "name")


# --- further listings, summaries and delivery

_SENTENCES = r"""
, x AS (SELECT id, regexp_replace(coalesce(body, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS x FROM reviews),
l AS (SELECT id, list_filter(string_split(regexp_replace(x, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS l FROM x),
s AS (SELECT id, len(l) AS total, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM l),
w AS (SELECT id, pos, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(sentence), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda y: y <> '')) AS word FROM s)"""


@query(_ORIGINAL + " SELECT id, importance_score FROM ae WHERE translated_at IS NULL ORDER BY importance_score DESC NULLS LAST, published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 25", *_AE)
def most_important_untranslated(cat):
    return articles.most_important(articles.filtered(cat, translated=False), 25).select("id", "importance_score")


@query(" SELECT DISTINCT concat('https://news.example/', CAST(id AS VARCHAR)) AS url FROM sources WHERE concat('https://news.example/', CAST(id AS VARCHAR)) IN (SELECT url FROM articles)", "articles", "sources")
def known_urls(cat):
    return articles.known_urls(cat.sources.select(F.concat(F.lit("https://news.example/"), F.col("id").cast("string")).alias("url")).distinct(), cat)


@query(_ORIGINAL + " SELECT id FROM ae WHERE headline_tr ILIKE '%IK 11%' OR headline_tr ILIKE '%note:%' OR length(headline_tr) > length(headline) - 3", *_AE)
def suspicious_translations(cat):
    return articles.suspicious_translations(articles.filtered(cat), ["IK 11", "note:"], 1, -3).select("id")


@query(_ORIGINAL + " SELECT region AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ae WHERE region IS NOT NULL), 1) AS share FROM ae WHERE region IS NOT NULL GROUP BY region", *_AE)
def region_facets(cat):
    return articles.facets(articles.filtered(cat), "region")


@query(", a AS (SELECT coalesce(strftime(published_at, '%Y-%m-%d'), 'undated') AS day, count(*) AS n FROM articles WHERE NOT is_duplicate GROUP BY 1) SELECT day, n, row_number() OVER (ORDER BY day = 'undated', day DESC) AS place FROM a", "articles")
def articles_by_day(cat):
    return articles.by_day(articles.originals(cat.articles))


@query(" SELECT DISTINCT metric_key FROM kpis", "kpis")
def metric_keys(cat):
    return cat.kpis.select("metric_key").distinct()


@query(" SELECT metric_key, min(value) - CASE WHEN min(value) = max(value) THEN CASE WHEN min(value) = 0 THEN 1 ELSE abs(min(value)) * 0.05 END ELSE 0 END AS low, max(value) + CASE WHEN min(value) = max(value) THEN CASE WHEN min(value) = 0 THEN 1 ELSE abs(min(value)) * 0.05 END ELSE 0 END AS high FROM kpis GROUP BY metric_key", "kpis")
def kpi_axis(cat):
    return series.axis(cat.kpis)


@query(_SENTENCES + ", t AS (SELECT id, word, count(*) AS n FROM w WHERE word NOT IN (" + ", ".join(f"'{x}'" for x in summary.STOP_WORDS) + ") GROUP BY ALL), p AS (SELECT w.id, w.pos, sum(t.n) AS score FROM w JOIN t USING (id, word) GROUP BY ALL), q AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY coalesce(score, 0) DESC, s.pos) AS nth FROM s LEFT JOIN p ON s.id = p.id AND s.pos = p.pos) SELECT r.id, coalesce(string_agg(q.sentence, ' ' ORDER BY pos), '') AS summary FROM reviews r LEFT JOIN q ON r.id = q.id AND (nth <= 3 OR total <= 2) GROUP BY r.id", "reviews")
def review_summaries(cat):
    return summary.summaries(cat.reviews)


@query(_SENTENCES + " SELECT id, word, count(*) AS n FROM w WHERE word NOT IN (" + ", ".join(f"'{x}'" for x in summary.STOP_WORDS) + ") GROUP BY ALL", "reviews")
def review_term_counts(cat):
    return summary.term_counts(cat.reviews)


@query(", s AS (SELECT DISTINCT CAST(as_of + INTERVAL 3 HOURS AS DATE) AS day FROM kpis WHERE metric_key = 'purchase' AND value > 300), r AS (SELECT id, hour(as_of + INTERVAL 3 HOURS) AS h, CAST(as_of + INTERVAL 3 HOURS AS DATE) IN (SELECT day FROM s) AS sent FROM kpis), x AS (SELECT id, CASE WHEN h < 9 THEN 'early' WHEN h >= 14 THEN 'late' WHEN sent THEN 'sent' ELSE 'due' END AS reason FROM r) SELECT id, reason, reason = 'due' AS due FROM x", "kpis")
def newsletter_due(cat):
    sent = cat.kpis.filter("metric_key = 'purchase' and value > 300").select(delivery.local_time(F.col("as_of")).cast("date").alias("day"))
    return delivery.due(cat.kpis.select("id", F.col("as_of").alias("now")), sent).select("id", "reason", "due")


@query(", d AS (SELECT id AS subscriber_id, CASE WHEN trust_weight > 0.8 THEN 'sent' ELSE 'failed' END AS status, round(trust_weight * 10)::BIGINT AS attempts FROM sources WHERE trust_weight >= 0.3), o AS (SELECT * FROM d UNION ALL SELECT id, 'pending', 0 FROM sources WHERE is_active AND trust_weight < 0.3), x AS (SELECT o.*, status <> 'sent' AND attempts < 5 AND s.is_active AS tried, s.category = 'MACHINERY' AS fails FROM o JOIN sources s ON s.id = o.subscriber_id) SELECT subscriber_id, CASE WHEN tried THEN CASE WHEN fails THEN 'failed' ELSE 'sent' END ELSE status END AS status, attempts + CASE WHEN tried THEN 1 ELSE 0 END AS attempts FROM x", "sources")
def newsletter_attempts(cat):
    status = F.when(F.col("trust_weight") > 0.8, "sent").otherwise("failed").alias("status")
    before = cat.sources.filter("trust_weight >= 0.3").select(F.col("id").alias("subscriber_id"), F.lit(1).cast("long").alias("edition_id"), status, F.round(F.col("trust_weight") * 10).cast("long").alias("attempts"))
    failing = cat.sources.filter("category = 'MACHINERY'").select(F.col("id").alias("subscriber_id"))
    return delivery.attempted(delivery.opened(before, cat.sources, 1), cat.sources, failing).select("subscriber_id", "status", "attempts")


# --- raw sources


@query("WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id AS id, count(*) AS points, sum(k)::BIGINT AS total FROM e WHERE k IS NOT NULL AND k % 3 <> 0 GROUP BY user_id")
def json_series(cat):
    # one quote document a user, as parallel arrays with gaps
    k = F.get_json_object("props", "$.k").cast("long")
    one = F.struct(F.col("event_id").alias("t"), F.when(k % 3 != 0, k).cast("double").alias("c"))
    docs = cat.table("events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    quote = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("x.t").alias("timestamp"), F.struct(F.array(F.struct(F.col("x.c").alias("close"))).alias("quote")).alias("indicators"))).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    found = feeds.quote_history(docs.select("id", quote.alias("json")))
    return found.groupBy("id").agg(F.count("*").alias("points"), F.sum("close").cast("long").alias("total"))


@query()
def page_texts(cat):
    return cat.table("pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r" SELECT id, 0 AS position, url, concat('Story ', id) AS title, concat('Body ', id, ' & more') AS content, coalesce(source_name, '') AS author, review_date + INTERVAL 9 HOURS AS at FROM reviews WHERE id % 4 <> 1 UNION ALL SELECT id, 1, concat(url, '/b'), 'Second', '', NULL, NULL FROM reviews WHERE id % 4 = 2", "reviews")
def feed_entries(cat):
    # one feed a review: in RSS, in RSS with two items and one without a title, in Atom, or broken
    date = lambda p: F.coalesce(F.date_format("review_date", p), F.lit(""))
    body, name = F.concat(F.lit("&lt;p&gt;Body "), "id", F.lit(" &amp;amp; more&lt;/p&gt;")), F.coalesce("source_name", F.lit(""))
    item = F.concat(F.lit("<item><title> Story "), "id", F.lit("</title><link>"), "url", F.lit("</link><description>"), body, F.lit("</description><author>"), name, F.lit("</author><pubDate>"), date("EEE, d MMM yyyy"), F.lit(" 09:00:00 GMT</pubDate></item>"))
    more = F.when(F.col("id") % 4 == 2, F.concat(F.lit("<item><title>Second</title><link>"), "url", F.lit("/b</link></item><item><link>x</link></item>"))).otherwise("")
    rss = F.concat(F.lit('<rss version="2.0"><channel><title>Feed</title>'), item, more, F.lit("</channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Story '), "id", F.lit('</title><link href="'), "url", F.lit('"/><content type="html">'), body, F.lit("</content><author><name>"), name, F.lit("</name></author><updated>"), date("yyyy-MM-dd"), F.lit("T09:00:00+00:00</updated></entry></feed>"))
    xml = F.when(F.col("id") % 4 == 1, "<rss><channel>").when(F.col("id") % 4 == 3, atom).otherwise(rss)
    found = feeds.feed_items(cat.reviews.select("id", xml.alias("xml")))
    return found.select("id", "position", "url", "title", "content", F.coalesce("author", F.when(F.col("position") == 0, "")).alias("author"), F.col("published_at").cast("timestamp_ntz").alias("at"))


@query(", q AS (SELECT id, url, rating, review_date FROM reviews WHERE id % 3 <> 0) SELECT id, CASE WHEN id % 3 = 1 THEN concat('https://reviews.example/list#anchor', id) ELSE 'https://reviews.example/list/2' END AS url, concat('The crew of flight ', id, ' were kind. Food was cold.') AS excerpt, review_date, rating, 'A. Guest' AS author, 'Rome to Oslo' AS route, CAST(NULL AS VARCHAR) AS cabin FROM q", "reviews")
def review_page_entries(cat):
    c, l = F.col, F.lit
    named = F.when(c("id") % 3 == 1, F.concat(l("comp list-item review-"), "id")).otherwise("comp")
    said = F.when(c("id") % 3 == 0, "The app crashed again and again.").otherwise(F.concat(l("<em>Trip Verified</em> | The crew of flight "), "id", l(" were kind.  Food was cold. Third.")))
    rating = F.when(c("rating").isNotNull(), F.concat(l('<div itemprop="reviewRating"><span itemprop="ratingValue">'), "rating", l("</span>/10</div>"))).otherwise("")
    date = F.when(c("review_date").isNotNull(), F.concat(l('<meta itemprop="datePublished" content="'), "review_date", l('">'))).otherwise("")
    page = F.concat(l('<html><article itemprop="review" class="'), named, l('">'), rating, date, l('<span itemprop="author"><span itemprop="name">A. Guest</span></span><div class="text" itemprop="reviewBody">'), said, l('</div><table><tr><td class="header route ">Route</td><td>Rome to Oslo</td></tr></table></article></html>'))
    return feeds.review_pages(cat.reviews.select("id", l("https://reviews.example/list/2").alias("page_url"), page.alias("html")), "https://reviews.example/list")


_STORY = (
    ", b AS (SELECT x.article_id, x.entity_id FROM article_entities x JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'airline')"
    ", r AS (SELECT DISTINCT a.id, lower(a.title) AS title, CAST(published_at AS DATE) AS day, e.headline_tr AS tr, coalesce(CAST(b.entity_id AS VARCHAR), concat('category:', e.category)) AS key FROM articles a JOIN enrichment e ON a.id = e.article_id LEFT JOIN b ON b.article_id = a.id WHERE NOT is_duplicate AND status = 'enriched' AND published_at IS NOT NULL)"
    f", t AS (SELECT *, list_distinct(list_filter(string_split({_normal('title')}, ' '), lambda x: x <> '')) AS w, list_distinct(list_filter(string_split({_normal('tr')}, ' '), lambda x: x <> '')) AS v, regexp_extract(title, '[0-9]+') AS number FROM r)"
    ", p AS (SELECT DISTINCT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS s, CASE WHEN len(a.v) > 0 AND len(b.v) > 0 THEN len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) ELSE 0 END AS z FROM t a JOIN t b ON a.key = b.key AND a.day = b.day AND a.id < b.id AND a.number = b.number)"
)


def _stories(cat: Catalog) -> tuple:
    return cat.articles.withColumn("title", F.lower("title")), cat.enrichment, articles.mentions(cat, "airline"), AS_OF, 4000


@query(_STORY + " SELECT a, b, round(greatest(s, z), 6) AS similarity FROM p WHERE greatest(s, z) >= 0.3", *_AE, "article_entities", "entities")
def same_story_pairs(cat):
    return dedup.story_pairs(*dedup.story_candidates(*_stories(cat))).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def second_pass(cat):
    return dedup.second_pass(*_stories(cat)).select("id", "is_duplicate", "duplicate_of_id", "status")


@query()
def first_pass(cat):
    status = F.when(F.col("id") % 3 == 0, "enriched").otherwise("new").alias("status")
    rows = cat.reviews.select("id", F.substring("body", 1, 60).alias("title"), F.col("body").alias("text"), F.col("review_date").alias("time"), F.coalesce("review_date", F.lit("2024-09-30").cast("date")).cast("timestamp_ntz").alias("fetched_at"), status)
    return dedup.first_pass(rows, REVIEW_DAY, 300)


_YEARS = ", y AS (SELECT max(as_of) AS as_of, count(*) AS n, count(*) % 37 + 50 AS lf FROM kpis GROUP BY source), m AS (SELECT as_of, n * 1.0 AS rpk, lf * 1.0 AS lf, n / (lf / 100) AS ask, n * 0.5 AS pax, n * 0.125 AS cargo, n * 0.25 AS extra, n * 0.0625 AS ebit FROM y)"


@query(
    _YEARS + ", l AS (" + " UNION ALL ".join(f"SELECT as_of, '{k}' AS metric_key, ({v})::DOUBLE AS value FROM m" for k, v in {
        "passengers_ytd": "rpk * 2 * 1e6", "load_factor": "lf", "rpk": "rpk * 1e9", "ask": "round(ask) * 1e9", "departures": "rpk * 1e6", "passenger_revenue_ytd": "pax * 1e9", "ancillary_revenue_ytd": "extra * 1e9",
        "total_aviation_revenue_ytd": "(pax + extra) * 1e9", "yield_per_rpk": "round(pax / rpk * 100, 2)", "rask": "round((pax + cargo + extra) / ask * 100, 2)", "cask": "round((pax + cargo + extra - ebit) / ask * 100, 2)",
    }.items()) + ") SELECT * FROM l", "kpis",
)
def published_kpis(cat):
    n = F.col("n").cast("double")
    years = cat.kpis.groupBy("source").agg(F.max("as_of").alias("as_of"), F.count("*").alias("n"))
    return series.published(years.select("as_of", (n * 2).alias("passengers"), n.alias("departures"), (F.col("n") % 37 + 50).cast("double").alias("load_factor"), n.alias("rpk"), (n * 0.5).alias("passenger_revenue"), (n * 0.125).alias("cargo_revenue"), (n * 0.25).alias("ancillary_revenue"), (n * 0.0625).alias("ebit")))


@query(", r AS (SELECT id, as_of, CASE WHEN id % 4 <> 0 THEN id % 10000 END AS a, CASE WHEN id % 5 <> 0 THEN id % 90 + 0.5 END AS b, CASE WHEN id % 6 <> 0 THEN id % 40 + 0.25 END AS u FROM kpis), l AS (SELECT as_of, 'flights_airborne' AS metric_key, a::DOUBLE AS value FROM r UNION ALL SELECT as_of, 'flights_today', a * 12 FROM r UNION ALL SELECT as_of, 'oil_price', b FROM r UNION ALL SELECT as_of, 'fuel_price', b + 57 FROM r UNION ALL SELECT as_of, 'fx_usd_try', u FROM r) SELECT as_of, metric_key, value::DOUBLE AS value FROM l WHERE value IS NOT NULL", "kpis")
def live_kpis(cat):
    unless = lambda k, v: F.when(F.col("id") % k != 0, v.cast("double"))
    return series.live(cat.kpis.select("as_of", unless(4, F.col("id") % 10000).alias("airborne"), unless(5, F.col("id") % 90 + 0.5).alias("brent"), unless(6, F.col("id") % 40 + 0.25).alias("usd_try")))


@query(" SELECT concat(metric_key, '_ly') AS metric_key, arg_min(value, (as_of, id)) AS value, false AS is_primary FROM kpis GROUP BY metric_key", "kpis")
def kpi_last_year_points(cat):
    return series.last_year(cat.kpis.select("metric_key", F.struct("as_of", "id").alias("at"), "value"))


@query(" SELECT as_of, value FROM kpis WHERE metric_key = 'purchase' AND is_primary AND as_of >= TIMESTAMP '2024-01-03'", "kpis")
def kpi_history(cat):
    return series.history(cat.kpis, "purchase", "2024-07-01", "6m")


@query(r", x AS (SELECT DISTINCT date_trunc('month', starts)::DATE AS month FROM calendar), g AS (SELECT month, CAST(month - INTERVAL 1 DAY * (isodow(month) - 1) AS DATE) AS first, (ceil((isodow(month) - 1 + day(last_day(month))) / 7) * 7)::BIGINT AS n FROM x), c AS (SELECT month, first, unnest(range(0, n)) AS cell FROM g) SELECT month, cell, CAST(first + INTERVAL 1 DAY * cell AS DATE) AS day, date_trunc('month', CAST(first + INTERVAL 1 DAY * cell AS DATE)) = month AS in_month FROM c", "calendar")
def month_cells(cat):
    return months.month_cells(cat.calendar.select(F.col("starts").alias("month")))


@query(_ORIGINAL + " SELECT e.article_id, e.headline, false AS changed FROM enrichment e JOIN articles a ON a.id = e.article_id WHERE e.article_id % 5 <> 0 UNION ALL SELECT e.article_id, concat('A long enough headline about story ', e.article_id), true FROM enrichment e JOIN articles a ON a.id = e.article_id WHERE e.article_id % 5 = 0", *_AE)
def cleaned_headlines(cat):
    credited = F.concat(F.lit("A long enough headline about story "), F.col("article_id").cast("string"), F.lit(" - Some Daily"))
    stored = cat.enrichment.withColumn("headline", F.when(F.col("article_id") % 5 == 0, credited).otherwise(F.col("headline")))
    return upkeep.cleaned_headlines(cat.articles, cat.sources, stored)


@query(" SELECT article_id, CASE WHEN article_id % 3 = 0 THEN concat('Haber ', article_id, ' tanıtıyor') WHEN headline_tr <> '' THEN headline_tr END AS headline_tr, CASE WHEN article_id % 3 = 0 OR headline_tr <> '' THEN translated_at END AS translated_at FROM enrichment", "enrichment")
def repaired_translations(cat):
    broken = F.concat(F.lit('(translated from English)\n"Haber '), F.col("article_id").cast("string"), F.lit(' tanıtüyor"'))
    stored = cat.enrichment.withColumn("headline_tr", F.when(F.col("article_id") % 3 == 0, broken).otherwise(F.col("headline_tr")))
    return upkeep.repaired_translations(stored)


@query(" SELECT id, 'deduped' AS status FROM articles WHERE NOT is_duplicate AND fetched_at >= TIMESTAMP '2000-08-02' UNION ALL SELECT id, status FROM articles WHERE is_duplicate OR fetched_at < TIMESTAMP '2000-08-02'", "articles")
def reset_articles(cat):
    return upkeep.reset_enrichment(cat.articles, cat.enrichment, cat.article_entities, AS_OF, 365)[0].select("id", "status")


@query(" SELECT e.article_id FROM enrichment e JOIN articles a ON a.id = e.article_id WHERE is_duplicate OR fetched_at < TIMESTAMP '2000-08-02'", *_AE)
def reset_enrichment(cat):
    return upkeep.reset_enrichment(cat.articles, cat.enrichment, cat.article_entities, AS_OF, 365)[1].select("article_id")


@query(" SELECT id, name FROM calendar WHERE contains(translate(lower(concat(name, ' İĞNE')), 'i̇ğ', 'iig'), 'igne') AND contains(name, '17')", "calendar")
def folded_search(cat):
    marked = cat.calendar.filter(F.contains(text.folded(F.concat("name", F.lit(" İĞNE"))), F.lit("igne")))
    return marked.filter(F.contains("name", F.lit("17"))).select("id", "name")


_PLACED = ", z AS (SELECT DISTINCT code, CAST(substr(code, 2) AS DOUBLE) AS lat FROM entities WHERE entity_type = 'airport')"


@query(", m AS (SELECT DISTINCT a.id, n.code FROM articles a JOIN article_entities x ON a.id = x.article_id JOIN entities n ON x.entity_id = n.id WHERE n.entity_type = 'airport' AND NOT is_duplicate AND coalesce(published_at, fetched_at) >= TIMESTAMP '2000-08-02'), r AS (SELECT l.code AS origin, r.code AS destination, count(*) AS n FROM m l JOIN m r ON l.id = r.id AND l.code < r.code GROUP BY ALL HAVING n >= 2 ORDER BY n DESC, origin, destination LIMIT 40)" + _PLACED + " SELECT r.*, p.lat AS origin_lat, -p.lat AS origin_lon, q.lat AS destination_lat, -q.lat AS destination_lon FROM r JOIN z p ON p.code = origin JOIN z q ON q.code = destination", "articles", "article_entities", "entities")
def located_routes(cat):
    lat = F.substring("code", 2, 9).cast("double")
    places = cat.entities.filter("entity_type = 'airport'").select("code", lat.alias("lat"), (-lat).alias("lon")).distinct()
    return graph.located(graph.routes(cat, AS_OF, 365), places)
