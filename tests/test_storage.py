"""Versioned tables, surrogate ids, lookups, the near-duplicate index and reclassification."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewire.operators import ids, minhash, upkeep
from tidewire.storage import lookup
from tidewire.storage.versions import Conflict, VersionedTable

SCHEMA = StructType([StructField("id", LongType()), StructField("value", StringType())])


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", SCHEMA, ["id"], 4)


def test_readers_of_old_versions_see_their_rows(spark, table):
    assert table.version() is None and table.read().collect() == []
    first = table.overwrite(rows(spark, *((i, "a") for i in range(20))), "seed")
    second = table.upsert(rows(spark, (3, "b"), (100, "new")))
    assert len(second.wrote) <= 2 and second.number == 1
    untouched = set(first.folders) - {str(k) for k in second.wrote}
    assert untouched and all(first.folders[k] == second.folders[k] for k in untouched)
    assert values(table.read(0)) == sorted(((i, "a") for i in range(20)), key=repr)
    assert dict(values(table.read())) == {**{i: "a" for i in range(20)}, 3: "b", 100: "new"}


def test_a_label_is_committed_once(spark, table):
    assert table.append(rows(spark, (1, "a")), "one") and table.append(rows(spark, (1, "a")), "one") is None
    assert table.upsert(rows(spark, (1, "b")), "two") and table.upsert(rows(spark, (1, "c")), "two") is None
    assert values(table.read()) == [(1, "b")] and table.committed("one").number == 0
    assert table.append(rows(spark), "none") is None  # nothing to commit


def test_absent_keys_are_inserted_and_null_is_a_key(spark, table):
    table.overwrite(rows(spark, (1, "a"), (None, "n")))
    table.insert_absent(rows(spark, (1, "x"), (None, "x"), (2, "b"), (2, "b")))
    assert values(table.read()) == sorted([(1, "a"), (None, "n"), (2, "b")], key=repr)


def test_two_writers_of_one_version(spark, table):
    table.overwrite(rows(spark, (1, "a")))
    before = table.version()
    made = table._write(rows(spark, (2, "b")))
    table.append(rows(spark, (3, "c")))
    with pytest.raises(Conflict):
        table._commit(before, before.folders | made, [0], None)
    assert values(table.read()) == [(1, "a"), (3, "c")]


def test_a_change_stays_in_its_partitions(spark, table):
    table.overwrite(rows(spark, *((i, "a") for i in range(20))))
    with pytest.raises(ValueError, match="didn't name"):
        table.change(rows(spark, (1, "a")), lambda old: old.unionByName(rows(spark, *((i, "z") for i in range(40)))))


def test_vacuum_keeps_what_versions_name(spark, table):
    for k in range(4):
        table.overwrite(rows(spark, (1, str(k)), (2, str(k))))
    assert table.vacuum(2) >= 2
    assert table.numbers() == [2, 3] and values(table.read(2)) == [(1, "2"), (2, "2")] and values(table.read()) == [(1, "3"), (2, "3")]


def test_numbers_follow_the_order_on_every_run(spark):
    data = spark.createDataFrame([(f"k{(i * 37) % 500:03d}",) for i in range(500)], "key string")
    runs = [{r.key: r.id for r in ids.numbered(data.repartition(n), ["key"], 10).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] == {f"k{i:03d}": 10 + i for i in range(500)}


def test_get_or_create(spark):
    known = spark.createDataFrame([(5, "airline", "A", "a1"), (9, "airport", None, None)], "id long, kind string, name string, code string")
    came = spark.createDataFrame([("airline", "A", "zz"), ("airport", None, "n"), ("airline", "C", "c2"), ("airline", "C", "c1"), ("airport", "A", None)], "kind string, name string, code string")
    got = values(ids.get_or_create(known, came, ["kind", "name"]))
    assert got == sorted([(5, "airline", "A", "a1"), (9, "airport", None, None), (10, "airline", "C", "c1"), (11, "airport", "A", None)], key=repr)
    assert values(ids.get_or_create(known.limit(0), came.limit(0), ["kind", "name"])) == []


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "sorted")
    data = spark.range(0, 400_000).select(F.xxhash64("id").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    lookup.save_sorted(data, path, partitions=4, row_group=1 << 20)
    wanted = [r.id for r in data.limit(3).collect()]
    found = lookup.by_ids(spark, path, data.schema, wanted)
    assert sorted(r.id for r in found.collect()) == sorted(wanted) and lookup.by_ids(spark, path, data.schema, []).collect() == []
    total = sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/*.parquet"))
    may = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            may += any(s.min <= w <= s.max for w in wanted)
    assert total >= 12 and may <= len(wanted)
    scan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(id" in scan.toString()
    node = scan
    while node.children().size():
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= may * 20_000


def test_only_changed_partitions_are_reclassified(spark, tmp_path):
    schema = StructType.fromDDL("article_id long, category string, region string, headline_tr string")
    table = VersionedTable(spark, f"file://{tmp_path}/enrichment", schema, ["article_id"], 8)
    table.overwrite(spark.createDataFrame([(i, "c", "asia", f"tr{i}") for i in range(40)], schema))
    articles = spark.createDataFrame([(i, i == 7, "enriched" if i != 8 else "new") for i in range(40)], "id long, is_duplicate boolean, status string")
    found = spark.createDataFrame([(i, "europe" if i in (3, 7, 8) else "asia") for i in range(40)], "article_id long, region string")
    new = upkeep.reclassify(table, articles, found, "r1")
    assert len(new.wrote) == 1
    got = {r.article_id: (r.region, r.headline_tr) for r in table.read().collect()}
    assert got == {i: ("europe" if i == 3 else "asia", f"tr{i}") for i in range(40)}
    assert {r.region for r in table.read(0).collect()} == {"asia"}
    assert upkeep.reclassify(table, articles, found, "r2") is None and upkeep.reclassify(table, articles, found, "r1") is None


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    index = minhash.MinHashIndex(spark, f"file://{tmp_path}/index", partitions=2)
    base = "one two three four five six seven eight nine ten eleven twelve"
    day1 = spark.createDataFrame([(1, base), (2, base), (3, None), (4, "quite another text of which nothing is like the first one at all")], "id long, text string")
    day2 = spark.createDataFrame([(5, base + " thirteen"), (6, base), (7, base + " thirteen fourteen")], "id long, text string")
    assert index.add(day1, "d1").collect() == []
    found = index.add(day2, "d2")
    pairs = {(r.a, r.b): round(r.similarity, 3) for r in minhash.expanded(found, index.members.read()).collect()}
    assert {(1, 5), (2, 5), (5, 6), (1, 7), (5, 7), (1, 2), (1, 6), (2, 6)} <= set(pairs) and pairs[1, 5] == round(8 / 9, 3) and not any(4 in p for p in pairs)
    before = [len(t.read().collect()) for t in (index.keys, index.forms, index.members)]
    assert index.add(day2, "d2").collect() == []
    assert [len(t.read().collect()) for t in (index.keys, index.forms, index.members)] == before
