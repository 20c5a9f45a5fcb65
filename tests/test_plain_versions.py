"""Queries without SQL, and rules decided in order, against plain versions."""

import datetime as dt
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tests.oracle import SMALL
from tidewire.functions import text
from tidewire.operators import articles, bundles, dedup, edition, insights, places, reviews, series, subscribers
from tidewire.plans import registered
from tidewire.plans.catalog import Catalog


def normal(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (text or "").lower())).strip()


def shingles(text, k=5):
    w = normal(text).split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def titles_alike(a, b):
    return jaccard(set(normal(a).split()), set(normal(b).split()))


def only_numbers_differ(a, b):
    bare = lambda x: re.sub(r"\s+", " ", re.sub(r"\d+", "", normal(x))).strip()
    return bare(a) == bare(b) and re.findall(r"\d+", a) != re.findall(r"\d+", b)


def greedily(order, partners):
    """id -> the earliest kept partner before it, or None."""
    kept, out = [], {}
    for i in order:
        out[i] = next((k for k in kept if k in partners.get(i, ())), None)
        if out[i] is None:
            kept.append(i)
    return out


def test_greedy_order(spark):
    rng = random.Random(5)
    time = {i: rng.randrange(20) for i in range(80)}
    pairs = {(a, b) for a in range(80) for b in range(a + 1, 80) if rng.random() < 0.04} | {(i, i + 1) for i in range(40)}
    partners = {}
    for a, b in pairs:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    rows = spark.createDataFrame([(i, t) for i, t in time.items()], "id long, time int")
    got = {r.id: r.duplicate_of for r in dedup.greedy(rows, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == greedily(sorted(time, key=lambda i: (time[i], i)), partners)


def test_first_pass(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    stories = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(8)]
    rows = []
    for i in range(70):
        s = rng.randrange(8)
        body = stories[s].split()
        for _ in range(rng.choice([0, 1, 6])):
            body[rng.randrange(40)] = "changed"
        title = rng.choice([f"Story {s} in short", f"Story {s} in short 5", "Nothing in common", f"The story {s} told in full"])
        day = dt.datetime(2024, 5, 1) + dt.timedelta(days=rng.randrange(12))
        rows.append((i, title, " ".join(body), day, day, rng.choice(["new", "new", "enriched", "deduped", "duplicate"])))
    table = spark.createDataFrame(rows, "id long, title string, text string, time timestamp_ntz, fetched_at timestamp_ntz, status string")
    got = {r.id: r.duplicate_of for r in dedup.first_pass(table, "2024-05-13", 6).collect()}
    pool = [r for r in rows if r[5] == "new" or r[5] in ("deduped", "enriched") and r[4] >= dt.datetime(2024, 5, 7)]
    partners = {}
    for a in pool:
        for b in pool:
            if a[0] != b[0] and "new" in (a[5], b[5]) and jaccard(shingles(a[2]), shingles(b[2])) >= 0.5 and titles_alike(a[1], b[1]) >= 0.25 and not only_numbers_differ(a[1], b[1]):
                partners.setdefault(a[0], set()).add(b[0])
    order = sorted(pool, key=lambda r: (r[5] == "new", r[3], r[0]))
    want = greedily([r[0] for r in order], partners)
    assert got == {r[0]: want[r[0]] for r in pool if r[5] == "new"} and sum(v is not None for v in got.values()) > 8


def test_second_pass(spark):
    day = lambda d, h: dt.datetime(2024, 5, d, h)
    rows = [
        (1, "Airline orders forty Airbus jets", "", day(1, 5), [7]), (2, "Airline orders forty jets from Airbus", "", day(1, 9), [7]),  # a story twice
        (3, "Airline orders forty Boeing jets", "", day(1, 10), [7]),  # another maker
        (4, "Airline orders forty Airbus jets", "", day(2, 5), [7]),  # another day
        (5, "Airline orders forty Airbus jets", "", day(1, 11), [8]),  # no entity in common
        (6, "Havayolu yeni hat", "Kırk jet siparişi geldi", day(1, 12), [9]), (7, "Carrier places order", "Kırk jet siparişi geldi", day(1, 13), [9]),  # alike once translated
        (8, "KLM cuts its winter flights", "", day(1, 6), []), (9, "SAS cuts its winter flights", "", day(1, 7), []), (10, "CEO cuts its winter flights", "", day(1, 8), []),  # parties; a general acronym is none
        (11, "Fares rise by 5 percent", "", day(1, 3), []), (12, "Fares rise by 7 percent", "", day(1, 4), []),  # numbers alone
    ]
    made = spark.createDataFrame([(i, t, at, False, None, "enriched") for i, t, _, at, _ in rows], "id long, title string, published_at timestamp_ntz, is_duplicate boolean, duplicate_of_id long, status string")
    enriched = spark.createDataFrame([(i, tr, "c") for i, _, tr, _, _ in rows], "article_id long, headline_tr string, category string")
    named = spark.createDataFrame([(i, e) for i, _, _, _, es in rows for e in es], "article_id long, entity_id long")
    got = {r.id: (r.duplicate_of_id, r.status) for r in dedup.second_pass(made, enriched, named, "2024-05-03", 10).collect()}
    assert {i: d for i, (d, _) in got.items() if d} == {2: 1, 7: 6, 10: 8} and got[2][1] == "duplicate" and got[1][1] == "enriched"


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append(" ")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        self.out.append("" if self.skip else data)


def test_page_texts(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in registered.QUERIES["page_texts"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        parser = Text()
        parser.feed(html or "")
        parser.close()
        assert got[i] == re.sub(r"\s+", " ", "".join(parser.out)).strip()


def test_repeats_across_blocks_of_time(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)), rng.choice([1.0, 2.0, None]), rng.choice(["s", "t", None])) for i in range(300)]
    got = {r.id for r in series.without_repeats(spark.createDataFrame(rows, "id long, metric_key string, as_of timestamp_ntz, value double, source string")).collect()}
    last, want = {}, set()
    for i, m, _, v, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if last.get(m, "none") != (v, s):
            want.add(i)
        last[m] = v, s
    assert got == want


def test_themes_read_a_text_once(spark):
    found = reviews.theme_stats(Catalog(spark, SMALL).reviews, registered.THEMES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    projected = [line for line in plan.split("\n") if "regexp_replace" in line]
    assert sum(line.count("regexp_replace") for line in projected) == 2, projected


def test_bundle_expands_articles_once(spark):
    cat = Catalog(spark, SMALL)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scans = lambda df: plan(df).count("FileScan parquet")
    bundle = bundles.insights(cat, registered.AS_OF, 90, "low")
    apart = [insights.momentum(cat, registered.AS_OF, 90), insights.sentiment_by_category(cat, registered.AS_OF, 90), insights.route_signals(cat, registered.AS_OF, 90, "low")]
    assert plan(bundle).count("Expand") == 1 and scans(bundle) < sum(map(scans, apart))


def test_entities_of_pages(spark):
    rows = {"&copy; &#169; &#xA9;": "© © ©", "a &amp;lt;b&amp;gt; c": "a c", "&nosuch; &amp; x": "&nosuch; & x", "&#0; &#99999999; &#xD800;": "\ufffd &#99999999; \ufffd", "no entity": "no entity", "5 &lt; 7": "5 < 7"}
    got = {r.h: r.t for r in spark.createDataFrame([(h,) for h in rows], "h string").select("h", text.strip_html(F.col("h")).alias("t")).collect()}
    assert got == rows


def test_totals_of_short_pages(spark):
    rows = spark.range(25)
    assert articles.total_of(rows, 5, 10, 20) == 25 and articles.total_of(rows, 10, 10, 0) == 25 and articles.total_of(rows, 0, 10, 40) == 25 and articles.total_of(rows.limit(0), 0, 10) == 0


def test_edition_titles(spark):
    rows = spark.createDataFrame([(1, None, "tr", "h", "t"), (2, 5, "tr", "h", "t"), (3, 5, "", "", "t"), (4, None, None, None, None)], "id int, at int, tr string, h string, t string")
    got = {r.id: r.x for r in rows.select("id", edition.title(F.col("at"), F.col("tr"), F.col("h"), F.col("t")).alias("x")).collect()}
    assert got == {1: "h", 2: "tr", 3: "t", 4: None}


def test_turkish_order_of_places(spark):
    names = ["Zambia", "İtalya", "Irak", "Çin", "Cezayir", "Şili", "Sudan", "Özbekistan", "Oman"]
    rows = spark.createDataFrame([(n, 1, None) for n in names], "place string, n int, region string")
    got = [r.place for r in sorted(places.by_region(rows).collect(), key=lambda r: r.nth)]
    assert got == ["Cezayir", "Çin", "Irak", "İtalya", "Oman", "Özbekistan", "Sudan", "Şili", "Zambia"]


def test_subscribers(spark):
    known = spark.createDataFrame([("A@x.org",)], "email string")
    came = spark.createDataFrame([("a@X.org", 1), ("b@x.org", 2), ("B@x.org", 3), (None, 4)], "email string, at int")
    assert {(r.email, r.created) for r in subscribers.signed_up(known, came).collect()} == {("a@X.org", False), ("b@x.org", True), ("B@x.org", False), (None, True)}
    rows = spark.createDataFrame([("a", True, 2), ("b", False, 1), ("c", True, 1)], "email string, is_active boolean, created_at int")
    assert [r.email for r in subscribers.listed(rows).collect()] == ["c", "a"]
