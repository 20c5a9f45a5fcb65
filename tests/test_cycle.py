"""A cycle over a small archive, step by step what must come of it."""

import datetime as dt

from tidewire.operators import cycle

ARTICLE = "id long, source_id long, url string, title string, body string, author string, published_at timestamp_ntz, fetched_at timestamp_ntz, word_count long, hash string, status string, is_duplicate boolean, duplicate_of_id long"
STORY = "Turkish carrier opens a new route from Istanbul to Lagos with daily flights and a great cabin for all of its guests this summer"


def test_cycle(spark):
    day = lambda h: dt.datetime(2024, 5, 2, h)
    archive = spark.createDataFrame([(10, 1, "u/known", "Carrier opens new route to Lagos", STORY, None, day(1), day(1), 22, "h", "enriched", False, None)], ARTICLE)
    enrichment = spark.createDataFrame([(10, "routes", "positive", "africa", None)], "article_id long, category string, sentiment string, region string, headline_tr string")
    links = spark.createDataFrame([(10, "airport:Lagos")], "article_id long, entity_id string")
    sources = spark.createDataFrame([(s, 0.5) for s in (1, 2, 3)], "id long, trust_weight double")
    items = spark.createDataFrame(
        [
            (1, "u/known", "An address that is known", "x", None, day(3)),
            (2, "u/copy", "Carrier opens its new route to Lagos", STORY + " again", "A" * 300, day(4)),  # a copy of the archive's
            (3, "u/story", "New route to Lagos: carrier opens it", "Wholly different words about Lagos", None, day(5)),  # the story in other words
            (3, "u/other", "Fuel prices fall", "Jet fuel is cheap, a bad day for refiners", None, None),
            (3, "u/other", "Fuel prices fall, again", "the address once more", None, None), (3, None, "no address", "x", None, None),
        ],
        "source_id long, url string, title string, content string, author string, published_at timestamp_ntz",
    )
    gazetteer = spark.createDataFrame([("lagos", "airport", "Lagos", "LOS", 0)], "alias string, entity_type string, name string, code string, ord int")
    regions = spark.createDataFrame([("nigeria", "africa")], "country string, region string"), spark.createDataFrame([("LOS", "nigeria")], "code string, country string")
    rules = cycle.Rules({"routes": ["route", "flights"], "fuel": ["fuel"]}, ["great", "cheap"], ["bad", "cheap fares"], gazetteer, *regions)
    articles, made, found, scores = cycle.run(archive, enrichment, links, sources, items, rules, "2024-05-03", 3)
    got = {r.url: r for r in articles.collect()}
    assert set(got) == {"u/known", "u/copy", "u/story", "u/other"} and {r.id for r in got.values()} == {10, 11, 12, 13}
    assert {u: (r.status, r.duplicate_of_id) for u, r in got.items()} == {"u/known": ("enriched", None), "u/copy": ("duplicate", 10), "u/story": ("duplicate", 10), "u/other": ("enriched", None)}
    assert len(got["u/copy"].author) == 200 and got["u/other"].title == "Fuel prices fall" and got["u/other"].word_count == 9
    by_id = {r.article_id: (r.category, r.sentiment, r.region) for r in made.collect()}
    assert by_id[got["u/other"].id] == ("fuel", "neutral", None) and by_id[got["u/story"].id] == ("routes", "neutral", "africa") and got["u/copy"].id not in by_id
    assert {(r.article_id, r.entity_id) for r in found.collect()} == {(10, "airport:Lagos"), (got["u/story"].id, "airport:Lagos")}
    assert {r.id: r.n_sources for r in scores.collect()} == {10: 3, got["u/other"].id: 1}
    same, *_ = cycle.run(articles, made, found, sources, items.limit(0), rules, "2024-05-03", 3)
    assert sorted(same.collect()) == sorted(articles.collect())
