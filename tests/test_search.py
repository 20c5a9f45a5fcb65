"""Stems, postings, ranks, and what a search reads."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import stem
from tidewire.operators import search

# Words and their stems from the published vocabulary of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "luxuriate": "luxuri", "hopping": "hop", "hoped": "hope", "falling": "fall", "happy": "happi", "cry": "cri", "by": "by", "say": "say", "relational": "relat", "conditional": "condit",
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol",
    "knightly": "knight", "knots": "knot", "knackeries": "knackeri", "kneeled": "kneel", "generate": "generat", "generously": "generous", "communism": "communism", "dying": "die", "skies": "sky", "news": "news",
    "proceed": "proceed", "canning": "canning", "youth": "youth", "yes": "yes", "boys": "boy", "enjoyable": "enjoy", "expansion": "expans", "expands": "expand", "airlines": "airlin", "airline": "airlin", "turkish": "turkish",
    "announced": "announc", "routes": "rout", "running": "run", "flies": "fli", "national": "nation", "nationality": "nation", "hopefulness": "hope", "controlling": "control", "roll": "roll", "bright": "bright", "a": "a", "777x": "777x",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "term string")
    assert {r.term: r.stem for r in stem.stems(rows).collect()} == STEMS


def test_stems_of_duckdb_are_the_same():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?) AS term", [list(STEMS)])
    assert dict(con.execute(f"SELECT term, stem FROM ({stem.duckdb_stems('v')})").fetchall()) == STEMS


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    docs = [
        (1, "Turkish Airlines expands Africa network. Turkish Airlines announced new routes across Africa."),
        (2, "Fuel prices rise slightly. Jet fuel prices ticked up this week."),
        (3, "An airline from Africa, and far from it a Turkish one"),
        (4, None), (5, ""), (6, "the and of"),
    ]
    search.save(search.postings(spark.createDataFrame(docs, "id long, text string"), "text"), path, 8)
    return search.load(spark, path)


def test_search_finds_inflected_words(index):
    got = {r.id: r["rank"] for r in search.search(index, "airline expanding in AFRICA", 8).collect()}
    assert set(got) == {1}
    got = {r.id: r["rank"] for r in search.search(index, "Turkish Airlines Africa", 8).collect()}
    assert set(got) == {1, 3} and got[1] > got[3] > 0
    assert search.search(index, "the of", 8).collect() == [] and search.search(index, "airline hotel", 8).collect() == []


def test_ranks(index):
    one = {r.id: r["rank"] for r in search.search(index, "prices", 8).collect()}
    assert one == {2: round(0.1 * (1 + 1 / 4) / 1.64493406685, 6)}
    import math

    two = {r.id: r["rank"] for r in search.search(index, "jet ticking", 8).collect()}
    assert two == {2: round(0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(3 / 1.5 - 2))), 6)}


def test_a_search_reads_its_terms_buckets_only(spark, index):
    found = search.search(index, "Turkish prices", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(stem" in plan.replace("\n", "")
    of = spark.range(1).select(search.bucket_of(F.lit("turkish"), 8), search.bucket_of(F.lit("price"), 8)).first()
    read = {f.rpartition("bucket=")[2].split("/")[0] for f in index.filter(F.col("bucket").isin(list(of))).inputFiles()}
    assert read <= {str(b) for b in of}


def test_stop_words_keep_their_places(spark):
    docs = spark.createDataFrame([(1, "the routes of the air"), (2, "x " * 20_000)], "id long, text string")
    got = {(r.id, r.stem): (r.n, r.places) for r in search.postings(docs, "text").collect()}
    assert got[1, "rout"] == (1, [2]) and got[1, "air"] == (1, [5]) and (1, "the") not in got
    assert got[2, "x"][0] == 20_000 and got[2, "x"][1] == list(range(1, 257))
