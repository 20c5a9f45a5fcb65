"""op6_ngram_jaccard: passes that find no link cost no new components, and pairs of one component aren't carried on."""

from tidewire.llm import ngram_join
from tidewire.llm.common import written


def test_a_pass_without_links_makes_no_components(spark, monkeypatch):
    made, real = [], ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda edges: made.append(1) or real(edges))
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:79], "other"]), " ".join(f"v{i}" for i in range(80))]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(made) == 1


def test_links_join_components_and_leave_pairs_apart(spark):
    edges = lambda rows, columns="a long, b long": written(spark.createDataFrame(rows, columns), "test")
    before = edges([(1, 1), (2, 1), (5, 5), (6, 5), (30, 30), (31, 30)], "node long, component long")
    after = ngram_join._merged(before, edges([(2, 6), (7, 8), (9, 31)]))
    assert sorted(map(tuple, after.collect())) == [(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 9), (30, 9), (31, 9)]
    left = ngram_join._apart(edges([(1, 6), (2, 7), (7, 8), (40, 41), (9, 30)]), after)
    assert sorted(map(tuple, left.collect())) == [(2, 7), (40, 41)]
