"""What the findings of round 3 asked for, in a third sitting."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.oracle import SMALL
from tidewire.operators import dedup, insights
from tidewire.plans.catalog import Catalog

DAY = dt.date(2024, 1, 2)


def _stories(spark, n):
    """Rows of one key and day in families of titles, some of another day or with a key of their own, some with their key twice."""
    makers = ("airbus", "boeing", "atr")
    rows = [(i, f"{makers[i % 3]} opens line number {i % 4} today" if i % 7 or i > 14 else "airbus opens a line today", f"baslik {i % 5}" if i % 2 else None, DAY if i % 6 else None) for i in range(n)]
    keys = [(i, "x") for i in range(n)] + [(i, "x") for i in range(0, n, 4)] + [(i, "y") for i in range(0, n, 5)] + [(i, f"own{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, title_tr string, day date"), spark.createDataFrame(keys, "id long, key string")


@pytest.mark.parametrize("few", [1, 32])
def test_f12_f17_stories_are_paired_at_once_or_by_their_words(spark, monkeypatch, few):
    from tidewire.functions.titles import same_story

    monkeypatch.setattr(dedup, "FEW", few)
    rows, keys = _stories(spark, 24)
    got = sorted((r.a, r.b) for r in dedup.story_pairs(rows, keys).collect())
    a, b = (rows.join(keys, "id").distinct().select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "title", "title_tr", "day", "key"))) for x in "ab")
    met = a.join(b, (F.col("id_a") < F.col("id_b")) & (F.col("key_a") == F.col("key_b")) & F.col("day_a").eqNullSafe(F.col("day_b")))
    want = met.filter(same_story(F.col("title_a"), F.col("title_b"), F.col("title_tr_a"), F.col("title_tr_b"))).select("id_a", "id_b").distinct()
    assert got == sorted(map(tuple, want.collect())) and got


def test_f12_f17_rows_alone_with_their_key_and_day_make_no_words(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(dedup, "similar_sets", lambda sets, least: asked.append(sets))
    rows = spark.createDataFrame([(i, "one title of all", None, DAY) for i in range(50)], "id long, title string, title_tr string, day date")
    keys = spark.createDataFrame([(i, str(i // 2) if i < 10 else f"own{i}") for i in range(50)], "id long, key string")
    assert sorted((r.a, r.b) for r in dedup.story_pairs(rows, keys).collect()) == [(i, i + 1) for i in range(0, 10, 2)]
    assert not asked


def test_f12_f17_titles_of_other_models_are_not_paired(spark, monkeypatch):
    met = []
    keep = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: met.append(keep(df, name)) or met[-1])
    rows = spark.createDataFrame([(i, f"low story {i // 2}", None, DAY) for i in range(100)], "id long, title string, title_tr string, day date")
    keys = spark.createDataFrame([(i, "category:low") for i in range(100)], "id long, key string")
    assert dedup.story_pairs(rows, keys).count() == 50
    assert met[-1].count() == 50


def test_f19_detectors_stand_on_rows_of_their_windows_made_once(spark):
    cat = Catalog(spark, SMALL)
    found = insights.alerts(cat, "2001-08-02", 90, "urgent", "A0", themes={"crew": ["that", "with"]}, today="2024-10-01")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the calendar of events alone reads lines, and texts are read before
    assert plan.count("l_orderkey#") and plan.count("customer") == 0 and "regexp" not in plan
    few = insights.recent(cat, "2001-08-02", 90)
    for detector in (insights.movers, insights.negative_clusters):
        assert sorted(map(str, detector(few, "2001-08-02", 90).collect())) == sorted(map(str, detector(cat, "2001-08-02", 90).collect()))
    assert sorted(map(str, insights.surges(few, "2001-08-02", 90, "urgent").collect())) == sorted(map(str, insights.surges(cat, "2001-08-02", 90, "urgent").collect()))
    assert sorted(map(str, insights.rival_promotions(few, "2001-08-02", 90, "urgent", "A0").collect())) == sorted(map(str, insights.rival_promotions(cat, "2001-08-02", 90, "urgent", "A0").collect()))
