"""What the findings of round 4 asked for."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup, minhash, review_store
from tidewire.storage.folder import shared_folder


@pytest.mark.parametrize(("limit", "strategy"), [(0, "merge"), (8 << 20, "broadcast")])
def test_f1_grams_of_texts_are_not_broadcast(spark, monkeypatch, limit, strategy):
    monkeypatch.setattr(review_store, "BROADCAST_BYTES", limit, raising=False)
    texts = spark.createDataFrame([(1, "abcdefgh" * 9), (2, "q" + "abcdefgh" * 8), (3, "bcd"), (4, "unlike")], "node long, text string")
    found = review_store.contained_heads(texts)
    # the join of grams leaves Spark no choice: the heads are broadcast where they are few, and else nothing is
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "Join Inner, ((q#" in line and f"rightHint=(strategy={strategy})" in line]
    assert sorted(map(tuple, found.collect())) == [(1, 1, True), (1, 3, False), (2, 1, False), (2, 2, True), (2, 3, False), (3, 3, True), (4, 4, True)]


def _families(spark):
    """Sets in families of near copies, copies among them, and sets that are like no other."""
    r = random.Random(3)
    out = []
    for f in range(12):
        base = [r.getrandbits(63) - (1 << 62) for _ in range(r.choice((1, 2, 3, 8, 17, 40)))]
        for _ in range(r.choice((1, 4, 9))):
            s = [x if r.random() < 0.85 else r.getrandbits(63) - (1 << 62) for x in base]
            out += [s] * r.choice((1, 1, 2))
    out += [[r.getrandbits(63) - (1 << 62) for _ in range(20)] for _ in range(30)] + [[]]
    return [(i, s) for i, s in enumerate(out)]


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_f3_f4_f5_only_sets_that_can_have_a_partner_are_held_against_each_other(spark, monkeypatch, least):
    rows = _families(spark)
    sets = spark.createDataFrame(rows, "id long, s array<long>")
    kinds, members = dedup.set_kinds(sets)
    first = {}
    for i, s in rows:
        first.setdefault(frozenset(s), i)
    first.pop(frozenset(), None)
    assert {r.form: r.n for r in kinds.select(F.col("id").alias("form"), "n").collect()} == {i: len(s) for s, i in first.items()}
    want = {(i, j): len(s & t) / len(s | t) for s, i in first.items() for t, j in first.items() if i < j and len(s & t) >= least * len(s | t)}
    possible = {r.id for r in dedup._possible(sets, kinds, least).collect()}
    assert {i for pair in want for i in pair} <= possible < set(first.values())
    # pairs in several parts are the same pairs
    for least_carried in (4_000_000, 200):
        monkeypatch.setattr(dedup, "CARRIED_LEAST", least_carried)
        monkeypatch.setattr(dedup, "CARRIED", 0)
        found = dedup.linked_sets(sets, least)
        assert {(r.a, r.b): r.similarity for r in found.collect()} == pytest.approx(want) and want
        assert (len(found.inputFiles()) > 0) and (found._jdf.queryExecution().optimizedPlan().toString().count("Relation") > 1) == (least_carried == 200)


def test_f3_f4_f5_intermediate_tables_are_deleted(spark):
    sets = spark.createDataFrame(_families(spark), "id long, s array<long>")
    root = Path(urlparse(shared_folder(spark)).path)
    before = set(root.iterdir()) if root.exists() else set()
    dedup.linked_sets(sets, 0.5).count()
    left = {p.name.rpartition("-")[0] for p in set(root.iterdir()) - before}
    assert left == {"links", "kinds", "members"}


def test_f2_sets_stand_in_the_index_only(spark, tmp_path):
    index = minhash.MinHashIndex(spark, f"file://{tmp_path}/index", partitions=2)
    base = "one two three four five six seven eight nine ten eleven twelve"
    root = Path(urlparse(shared_folder(spark)).path)
    before = set(root.iterdir()) if root.exists() else set()
    # an id that comes twice, with copies and with another text
    first = spark.createDataFrame([(1, base), (1, base), (1, base + " thirteen"), (2, None)], "id long, text string")
    found = index.add(first, "d1")
    assert [round(r.similarity, 6) for r in found.collect()] == [round(8 / 9, 6)]
    assert index.forms.read().count() == 2 == index.forms.added("d1").count() and index.members.read().count() == 3
    again = index.add(spark.createDataFrame([(3, base), (4, base + " thirteen fourteen")], "id long, text string"), "d2")
    new = {r.form for r in index.forms.added("d2").collect()}
    assert [(r.form in new, r.other in new, round(r.similarity, 6)) for r in again.orderBy("similarity").collect()] == [(True, False, 0.8), (True, False, 0.9)]
    assert {p.name.rpartition("-")[0] for p in set(root.iterdir()) - before} <= {"matches", "links"}
