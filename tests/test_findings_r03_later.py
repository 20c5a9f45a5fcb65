"""What the findings of round 3 asked for, in a second sitting."""

from pyspark.sql import functions as F

from tidewire.functions.text import clip_excerpt
from tidewire.operators import articles, review_store, search, summary


def test_f2_heads_are_numbers_in_the_rounds_of_the_review_store(spark):
    head = "x" * 60
    texts = spark.createDataFrame([(1, head + "a"), (2, "q" + head), (3, "unlike"), (4, head + "b")], "node long, text string")
    found = review_store.contained_heads(texts)
    assert dict(found.dtypes) == {"node": "bigint", "head": "bigint", "own": "boolean"}
    assert sorted(map(tuple, found.collect())) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (4, 1, True)]


def test_f2_excerpts_are_made_once(spark):
    rows = spark.createDataFrame([(" One.  Two! Three?",), ("a" * 300 + ". Short.",), ("word " * 90,), ("",), (None,)], "t string").select(clip_excerpt(F.col("t")).alias("e"))
    assert [r.e for r in rows.collect()] == ["One. Two!", "a" * 279 + "…", ("word " * 55).strip() + "…", "", ""]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("\\s+, ") <= 2


def test_f6_f7_f8_an_index_is_built_with_one_shuffle_of_its_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Price of prices, the PRICED list"), (2, None), (3, "the of"), (4, "price " * 300 + "listing")], "id long, body string")
    path = f"file://{tmp_path}/index"
    search.build(docs, "body", path, 4)
    row = lambda r: (r.stem, r.id, r.n, r.places)
    want = [("list", 1, 1, [6]), ("list", 4, 1, [301]), ("price", 1, 3, [1, 3, 5]), ("price", 4, 300, list(range(1, 257)))]
    assert sorted(row(r) for r in search.load(spark, path).collect()) == want
    index = search.postings(docs, "body")
    assert sorted(row(r) for r in index.collect()) == want
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    assert plan.rpartition("Initial Plan")[2].count("Exchange hashpartitioning") == 1


def test_f16_summaries_are_made_within_their_rows(spark):
    docs = spark.createDataFrame([(1, "Crew kind. Seat old! Crew kind crew? The end."), (2, "One. Two."), (3, None), (4, "The. Of. A. Is.")], "id long, body string")
    found = summary.summaries(docs)
    assert {r.id: r.summary for r in found.collect()} == {1: "Crew kind. Seat old! Crew kind crew?", 2: "One. Two.", 3: "", 4: "The. Of. A."}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_f20_words_are_made_once_a_text(spark):
    docs = spark.createDataFrame([(1, "thon thre thon"), (2, "thon"), (3, None)], "id long, body string")
    found = articles.search(docs, "thon thre", "body", "id")
    assert [r.id for r in found.collect()] == [1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
