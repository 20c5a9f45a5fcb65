import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scoring, text, titles
from tidewire.operators import dedup, enrich, graph, insights, merge, series
from tidewire.sources import feeds
from tidewire.streaming import intake


def values(spark, *columns, row=None):
    return tuple(spark.createDataFrame([row or (1,)], ["_"] if row is None else None).select(*columns).first())


def test_normal_form_and_hash(spark):
    a, b, none = values(spark, text.normalize(F.lit("  Hello,   WORLD-2! ")), text.normalize(F.lit("hello world 2")), text.normalize(F.lit(None).cast("string")))
    assert a == b == "hello world 2" and none == ""


def test_shingles_of_short_and_empty_texts(spark):
    words = [F.array(*map(F.lit, "a b c d e f".split())), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")]
    assert values(spark, *(text.shingles(w) for w in words)) == (["a b c d e", "b c d e f"], ["a b"], [])


def test_titles(spark):
    title = lambda a, b: text.differ_only_by_number(F.lit(a), F.lit(b))
    assert values(spark, title("Orders 20 jets", "Orders 30 jets"), title("Orders 20 jets", "Orders 20 jets"), title("Orders 20 jets", "Sells 30 jets")) == (True, False, False)


def test_publisher_suffix(spark):
    strip = lambda h: text.strip_publisher(F.lit(h), F.lit("Daily News"))
    long_, short, other = values(spark, strip("A long enough headline about routes - Daily News"), strip("Short - Daily News"), strip("A long enough headline about routes - part two"))
    assert long_ == "A long enough headline about routes" and short == "Short - Daily News" and other == "A long enough headline about routes"
    kept, radar = values(spark, strip("A long enough headline about routes - here is why it happened in seven words."), text.strip_publisher(F.lit("A long enough headline about routes - Some Outlet"), F.lit("News radar")))
    assert kept.endswith("words.") and radar == "A long enough headline about routes"


def test_html_and_excerpts(spark):
    found = values(spark, text.strip_html(F.lit("<p>A &amp;amp; B<script>x()</script></p><!-- c -->")), text.clip_excerpt(F.lit("One. Two! Three.")), text.cut(F.lit("some words here"), 12))
    assert found == ("A & B", "One. Two!", "some words…")
    clip = lambda x: text.clip_excerpt(F.lit(x))
    first, cut, none = values(spark, clip("First one  is here. " + "b" * 270 + "."), clip("word, " * 60), text.clip_excerpt(F.lit(None).cast("string")))
    assert first == "First one is here." and cut == ("word, " * 46)[:-2] + "…" and none == ""


def test_translations(spark):
    clean = lambda s, r: text.clean_translation(F.lit(s), F.lit(r))
    assert values(spark, clean("short", '(a note on the translation)\nNote: free\n\n"kurz"\nmore'), clean("x", "y" * 100)) == ("kurz", None)
    assert values(spark, clean("l" * 201, "Not: x\none\n\ntwo"), clean("x", "Note: nothing else")) == ("one\n\ntwo", None)


def test_scores(spark):
    taxonomy = {"fleet": ["jet", "order"], "routes": ["route"]}
    best = lambda t, b: scoring.best_category(F.lit(t), F.lit(b), taxonomy)
    assert values(spark, best("New route", "jet jet"), best("A jet", "route route route"), best("nothing", ""), best("jetty", "")) == ("routes", "fleet", "general", "general")
    assert values(spark, scoring.confidence(F.lit(2), F.lit(0.5)), scoring.importance(F.lit(0.7), F.lit(9)), scoring.percent_change(F.lit(5.0), F.lit(0.0))) == (0.7, 0.79, None)
    assert values(spark, scoring.lexicon_sentiment(F.lit("good good bad"), ["good"], ["bad"]), scoring.rating_sentiment(F.lit(7), F.lit("x"))) == ("neutral", "positive")


def test_greedy_keeps_what_only_a_duplicate_resembles(spark):
    rows = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, time long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert dict(dedup.greedy(rows, pairs).collect()) == {1: None, 2: 1, 3: None, 4: None, 5: 4}


def test_similar_pairs(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-2])), (3, " ".join(reversed(base))), (4, ""), (5, None)]
    assert [(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame(rows, "id long, text string")).collect()] == [(1, 2)]


def test_title_gate(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    titles = spark.createDataFrame([(1, "Carrier orders 20 jets"), (2, "Carrier orders new jets"), (3, "Carrier orders 30 jets")], "id long, title string")
    assert [(r.a, r.b) for r in dedup.title_gate(pairs, titles).collect()] == [(1, 2)]


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, note string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z"), (3, "C", "Z")], "id long, name string, note string")
    assert sorted(map(tuple, merge.upsert(old, new.distinct(), ["id"], ["name"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]
    assert sorted(map(tuple, merge.insert_absent(old, new, ["id"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "Z")]
    assert sorted(map(tuple, merge.replace_part(old, new, "id", 2).collect())) == [(1, "a", "x"), (2, "B", "Y")]


def test_runs_of_equal_readings(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, "k", v, day + dt.timedelta(minutes=i), "s", True) for i, v in enumerate([8.9] * 5 + [9.4] * 5)]
    kpis = spark.createDataFrame(rows, "id long, metric_key string, value double, as_of timestamp_ntz, source string, is_primary boolean")
    assert sorted(r.id for r in series.without_repeats(kpis).collect()) == [0, 5]
    assert series.changed(kpis.filter("id = 9"), kpis.filter("id < 9")).count() == 0


def test_json_sources(spark):
    chart = {"chart": {"result": [{"meta": {"regularMarketPrice": 4.5}, "timestamp": [1, 2, 3], "indicators": {"quote": [{"close": [1.0, None, 3.0]}]}}]}}
    docs = lambda x: spark.createDataFrame([(1, json.dumps(x))], "id long, json string")
    assert [r.close for r in feeds.quote_history(docs(chart)).collect()] == [1.0, 3.0]
    assert feeds.quote_price(docs(chart)).first().price == 4.5
    assert feeds.exchange_rate(docs({"rates": {"EUR": 0.9}}), "EUR").first().rate == 0.9
    assert feeds.airborne(docs({"states": [[0] * 8 + [False], [0] * 8 + [True]]})).first().n == 1
    entry = {"id": {"label": "r1"}, "content": {"label": "A fine flight with a friendly crew."}, "im:rating": {"label": "4"}}
    assert [(r.id, r.excerpt, r.rating) for r in feeds.store_reviews(docs({"feed": {"entry": entry}}), "tr").collect()] == [(1, "A fine flight with a friendly crew.", 8.0)]


def test_a_failing_source_leaves_the_others(spark):
    def broken(_):
        raise OSError("gone")

    rows, errors = feeds.survivors({"a": lambda s: s.range(2), "b": broken}, spark)
    assert rows.count() == 2 and list(errors) == ["b"]


def test_stream_of_articles(spark, tmp_path):
    source, seen = tmp_path / "in", []
    rows = [("u1", dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6)), ("u1", None, dt.datetime(2024, 1, 1, 7)), ("u2", None, dt.datetime(2024, 1, 2, 7))]
    spark.createDataFrame(rows, "url string, published_at timestamp, fetched_at timestamp").write.parquet(str(source))
    stream = intake.unique(intake.event_time(spark.readStream.schema("url string, published_at timestamp, fetched_at timestamp").parquet(str(source))))
    intake.into(stream, lambda df, _: seen.extend(r.url for r in df.collect()), str(tmp_path / "cp")).start().awaitTermination(120)
    assert sorted(seen) == ["u1", "u2"]


def test_conflicting_titles(spark):
    clash = lambda a, b: titles.conflict(F.lit(a), F.lit(b))
    found = values(
        spark,
        clash("Carrier firms up order for Airbus A350s", "Carrier firms up order for Boeing jets"),
        clash("Carrier takes its first A350", "Carrier takes its first 787"),
        clash("Carrier signs agreement with CAE", "Carrier signs agreement with HAVELSAN"),
        clash("CEO of the carrier speaks", "FAA hears of the carrier"),
        clash("Carrier takes its first A350", "The A350 is at the carrier"),
    )
    assert found == (True, True, True, False, False)


def test_same_story_in_either_language(spark):
    same = lambda *x: titles.same_story(*(F.lit(v).cast("string") for v in x))
    found = values(
        spark,
        same("Carrier incorpora nuevos servicios", "New ancillary services at carrier", "yeni ek hizmetler", "yeni hizmetler geldi"),
        same("Carrier incorpora nuevos servicios", "New ancillary services at carrier", "yeni ek hizmetler", None),
        same("Orders 20 jets", "Orders 30 jets", None, None),
    )
    assert found == (True, False, False)


def test_quotable_excerpts(spark):
    texts = ("10", "The app crashes whenever I try to log in again", "The app is clunky but the crew were lovely", "Sure, here's a draft in your voice about the flight", None)
    assert values(spark, *(titles.quotable(F.lit(t).cast("string")) for t in texts)) == (False, False, True, False, False)


def test_overrides_need_evidence_and_margin(spark):
    def of(chosen, **scores):
        raw = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("score")) for c, s in scores.items()))
        return enrich.overruled(F.lit(chosen), raw)

    assert values(spark, of("rm", rm=1, fleet=3), of("rm", rm=2, fleet=2), of("rm", rm=0, fleet=2), of("none", rm=4, fleet=4), of("none", rm=4, fleet=1)) == ("fleet", None, None, None, "rm")


def test_entities_are_whole_words_and_regions_fall_back(spark):
    rows = spark.createDataFrame([(1, "Management meets"), (2, "ANA flies to Heathrow"), (3, "Spain and Heathrow"), (4, None)], "id long, body string")
    known = spark.createDataFrame([("ana", "airline", "All Nippon", "NH", 0), ("heathrow", "airport", "Heathrow", "LHR", 1), ("spain", "country", "Spain", None, 2)], "alias string, entity_type string, name string, code string, ord int")
    found = enrich.entities(rows, known, "body")
    assert sorted((r.id, r.name) for r in found.collect()) == [(2, "All Nippon"), (2, "Heathrow"), (3, "Heathrow"), (3, "Spain")]
    places = spark.createDataFrame([("spain", "south"), ("uk", "north")], "country string, region string")
    airports = spark.createDataFrame([("LHR", "uk")], "code string, country string")
    assert sorted(map(tuple, enrich.regions(found, places, airports).collect())) == [(2, "north"), (3, "south")]
    assert enrich.entities(rows, known.limit(0), "body").count() == 0


def test_labelled_pairs(spark):
    pair = lambda x: text.labelled_pair(F.lit(x).cast("string"))
    both, one, none, null = values(spark, pair("intro\nHEADLINE: A b\nc\n\nözet : D\ne"), pair("SUMMARY: only"), pair("nothing marked"), pair(None))
    assert (both.headline, both.summary) == ("A b c", "D e") and (one.headline, one.summary) == (None, "only")
    assert (none.headline, none.summary) == (None, None) and (null is None or null.headline is None)


def test_vowel_harmony(spark):
    fix = lambda x: text.vowel_harmony(F.lit(x))
    assert values(spark, fix("tanıtüyor ve geliyor"), fix("GÖRÜYOR KOŞIYOR"), fix("gülıyor, okiyor"), fix("brrüyor")) == ("tanıtıyor ve geliyor", "GÖRÜYOR KOŞUYOR", "gülüyor, okuyor", "brrüyor")


def test_feed_times_and_broken_feeds(spark):
    at = lambda x: feeds.feed_time(F.lit(x)).cast("string")
    assert values(spark, at("Tue, 05 Mar 2024 10:00:00 +0300"), at("2024-03-05T10:00:00Z"), at(" 09:00:00 GMT"), at("soon")) == ("2024-03-05 07:00:00", "2024-03-05 10:00:00", None, None)
    docs = spark.createDataFrame([(1, "<rss><channel>"), (2, None), (3, "")], "id long, xml string")
    assert feeds.feed_items(docs).count() == 0


def test_forum_posts(spark):
    entry = lambda title, body: f'<entry><title>{title}</title><link href="https://f/1"/><author><name>/u/a</name></author><content type="html">{body}</content><updated>2024-03-05T10:00:00+00:00</updated></entry>'
    own = "&lt;div class=\"md\"&gt;&lt;p&gt;Crew were kind on my long flight home. &lt;a href=\"x\"&gt;[link]&lt;/a&gt;&lt;/p&gt;&lt;/div&gt; submitted by"
    xml = '<feed xmlns="http://www.w3.org/2005/Atom">' + entry("T", own) + entry("A title long enough to be quoted", "&lt;table/&gt;") + entry("Short", "") + "</feed>"
    found = feeds.forum_posts(spark.createDataFrame([(1, xml)], "id long, xml string")).orderBy("excerpt").collect()
    assert [r.excerpt for r in found] == ["A title long enough to be quoted", "Crew were kind on my long flight home."]
    assert all(r.author == "u/a" and r.review_date == dt.date(2024, 3, 5) for r in found)


def test_second_pass_keeps_the_earliest(spark):
    day = lambda h: dt.datetime(2024, 5, 1, h)
    titles_ = {1: "carrier adds new leisure routes", 2: "new leisure routes added by carrier", 3: "carrier adds new leisure routes", 4: "carrier orders 20 jets", 5: "carrier orders 30 jets"}
    articles = spark.createDataFrame([(i, t, day(6 - i if i < 3 else i), False, None, "enriched") for i, t in titles_.items()], "id long, title string, published_at timestamp_ntz, is_duplicate boolean, duplicate_of_id long, status string")
    enrichment = spark.createDataFrame([(i, None, "network") for i in titles_], "article_id long, headline_tr string, category string")
    named = spark.createDataFrame([(3, 7), (4, 7), (5, 7)], "article_id long, entity_id long")
    found = {r.id: (r.is_duplicate, r.duplicate_of_id, r.status) for r in dedup.second_pass(articles, enrichment, named, "2024-05-02").collect()}
    # 2 is the earlier of the pair without entities; 3 is in no group with them; 4 and 5 differ in a number only
    assert found == {1: (True, 2, "duplicate"), **{i: (False, None, "enriched") for i in (2, 3, 4, 5)}}


def test_first_pass_spares_known_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "story of a route", body, 9, 1, "new"), (2, "story of a route", body, 5, 1, "enriched"), (3, "story of a route", body, 1, 1, "new"), (4, "story of a route", body, 1, 30, "enriched"), (5, "story 1", body, 9, 1, "new")]
    day = lambda d: dt.datetime(2024, 5, 31) - dt.timedelta(days=d)
    df = spark.createDataFrame([(i, t, b, day(a), day(f), s) for i, t, b, a, f, s in rows], "id long, title string, text string, time timestamp_ntz, fetched_at timestamp_ntz, status string")
    assert {r.id: r.duplicate_of for r in dedup.first_pass(df, "2024-05-31").collect()} == {1: 2, 3: 2, 5: None}


def test_cross_check_and_fuel_history(spark):
    assert values(spark, series.cross_check(F.lit(32.0), F.lit(32.16)), series.cross_check(F.lit(0.0), F.lit(1.0))) == (0.5, 0.0)
    assert series.fuel_history(spark.createDataFrame([(1, 80.0)], "as_of int, value double")).first().value == 94.4


def test_narrowing_takes_only_known_dimensions(spark):
    found = spark.createDataFrame([("a", "x", None, "tk"), ("b", None, "r", None)], "detector string, category string, region string, airline string")
    assert [r.detector for r in insights.narrowed(found, {"airline": ["TK"], "region": []}).collect()] == ["a"]
    assert insights.narrowed(found, {}).count() == 2
    with pytest.raises(ValueError):
        insights.narrowed(found, {"theme": ["x"]})


def test_regions_of_places(spark):
    counts, known = spark.createDataFrame([("Norway", 3), ("Atlantis", 0)], "place string, n long"), spark.createDataFrame([("norway", "europe")], "name string, region string")
    assert {tuple(r) for r in graph.with_regions(counts, known).collect()} == {("Norway", 3, "europe"), ("Atlantis", 0, "other")}
