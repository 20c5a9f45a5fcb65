"""Streams: changes only, rescoring with batches that come again, counts by period, and feeds as a source."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup, series
from tidewire.functions import scoring
from tidewire.sources import feed_source
from tidewire.streaming import changes, intake, rescoring

READING = "metric_key string, as_of timestamp, id long, value double, source string"


def staged(spark, tmp_path, batches, schema):
    """A stream of one file a batch, in order."""
    folder = tmp_path / f"in-{uuid.uuid4().hex}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{k:03d}")
    files = sorted(folder.glob("*/part-*.json"))
    inbox = tmp_path / f"inbox-{uuid.uuid4().hex}"
    inbox.mkdir()
    import os

    for k, f in enumerate(files):
        target = inbox / f"{k:03d}.json"
        f.rename(target)
        os.utime(target, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def test_changes_are_those_of_the_whole_table(spark, tmp_path):
    changes.use_rocksdb(spark)
    end = [("fuel", day(60), 999, 0.0, "end"), ("fx", day(60), 998, 0.0, "end")]
    batches = [
        [("fuel", day(0), 1, 5.0, "a"), ("fuel", day(2), 3, 5.0, "a"), ("fx", day(0), 4, 1.0, "a")],
        [("fuel", day(1), 2, 6.0, "a"), ("fuel", day(2), 3, 5.0, "a"), ("fx", day(1), 5, 1.0, "a"), ("fx", day(1), 6, 1.0, "b")],  # late, repeated, and two at a time
        [("fuel", day(5), 7, 5.0, "a"), ("fuel", day(6), 8, None, "a"), ("fuel", day(7), 9, None, "a"), ("fx", day(8), 10, 1.0, "a")],
        end,
        [("fuel", day(90), 1000, 0.0, "end"), ("fx", day(90), 1001, 0.0, "end")],
    ]
    stream = changes.changes(staged(spark, tmp_path, batches, READING), "3 days")
    name = f"changed_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.metric_key, r.id) for r in spark.table(name).collect()}
    table = spark.createDataFrame(sorted({r for b in batches for r in b}, key=repr), READING)
    want = {(r.metric_key, r.id) for r in series.without_repeats(table).collect()}
    assert got - {("fuel", 1000), ("fx", 1001)} == want - {("fuel", 1000), ("fx", 1001)} and ("fuel", 3) in got and ("fuel", 9) not in got


ARTICLE = "id long, source_id long, is_duplicate boolean, duplicate_of_id long"


def test_rescored_groups_follow_late_duplicates(spark, tmp_path):
    sources = spark.createDataFrame([(s, s / 10) for s in range(1, 8)], "id long, trust_weight double")
    batches = [
        [(1, 1, False, None), (2, 2, False, None), (5, 3, True, 9)],  # a duplicate before its original
        [(3, 2, True, 1), (4, 2, True, 1), (9, 4, False, None)],
        [(6, 5, True, 1), (7, 99, True, 2)],
    ]
    state = rescoring.Rescoring(spark, f"file://{tmp_path}/state", sources, 4)
    state.run(staged(spark, tmp_path, batches, ARTICLE), str(tmp_path / "ck")).start().awaitTermination()
    got = {r.id: (r.n_sources, r.confidence, r.importance) for r in state.scores.read().collect()}
    table = spark.createDataFrame([r for b in batches for r in b], ARTICLE)
    found = dedup.corroboration(table, sources).withColumn("confidence", scoring.confidence(F.col("n_sources"), F.col("mean_trust")))
    want = {r.id: (r.n_sources, r.confidence, r.importance) for r in found.withColumn("importance", scoring.importance(F.col("confidence"), F.col("n_sources"))).collect()}
    assert got == want and got[1][0] == 3 and got[9][0] == 2
    # a batch that comes again, also after a failure between the two commits, changes nothing
    versions = state.members.numbers(), state.scores.numbers()
    state.step(spark.createDataFrame(batches[2], ARTICLE), 2)
    assert (state.members.numbers(), state.scores.numbers()) == versions
    state.members.change(spark.createDataFrame([(2, 6, False)], state.members.schema), lambda old: old.unionByName(spark.createDataFrame([(2, 6, False)], state.members.schema)), "rescoring-7")
    state.step(spark.createDataFrame([(8, 6, True, 2)], ARTICLE), 7)
    assert {r.id: r.n_sources for r in state.scores.read().collect()}[2] == 2


def test_counts_by_period_and_sliding_windows(spark, tmp_path):
    schema = "url string, published_at timestamp, fetched_at timestamp"
    batches = [[("a", day(0), day(0)), ("a", day(0), day(0)), ("b", None, day(1, 5))], [("c", day(1), day(2)), ("d", day(40), day(40))], [("e", day(80), day(80))]]
    rows = intake.event_time(staged(spark, tmp_path, batches, schema))
    for k, (stream, want) in enumerate([(intake.counts(intake.unique(rows), late=None), {day(0): 1, day(1): 2, day(40): 1}), (intake.counts(intake.event_time(staged(spark, tmp_path, batches, schema)), "2 days", slide="1 day"), None)]):
        name = f"counts_{uuid.uuid4().hex}"
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck{k}")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {r.start: r.n for r in spark.table(name).collect()}
        if want:
            assert got == want
        else:
            assert got[day(0)] == 4 and got[day(1)] == 2 and got[day(-1)] == 2


def feed(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link></item>" for t, u in items) + "</channel></rss>"


@pytest.fixture
def feeds(tmp_path):
    def made(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    return made


def test_feeds_fail_by_themselves(spark, feeds):
    many = feed(*((f"t{i}", f"https://x/{i}") for i in range(60)))
    sources = [
        {"name": "own", "type": "rss", "url": feeds("own.xml", many)},
        {"name": "radar", "type": "rss", "url": feeds("news.google.com.xml", many)},
        {"name": "gone", "type": "rss", "url": "file:///nowhere/at/all.xml"},
        {"name": "torn", "type": "rss", "url": feeds("torn.xml", "<rss><channel><item>")},
        {"name": "empty", "type": "rss", "url": feeds("empty.xml", feed())},
        {"name": "stub", "type": "premium"},
        {"name": "odd", "type": "gopher"},
    ]
    read = feed_source.read_feeds(spark, sources)
    assert read.rdd.getNumPartitions() == len(sources)
    got = feed_source.items(read).collect()
    by = lambda s: [r for r in got if r.source == s]
    assert len(by("own")) == 60 and [r.url for r in sorted(by("radar"), key=lambda r: r.position)] == [f"https://x/{i}" for i in range(40)]
    assert by("gone")[0].error.startswith("URLError") and by("torn")[0].error == "not a feed" and by("odd")[0].error.startswith("ValueError")
    assert by("stub") == by("empty") == []
    assert json.dumps([]) == "[]" and feed_source.read_feeds(spark, []).collect() == []
