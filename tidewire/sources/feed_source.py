"""Feeds as a data source of Spark: a partition a source, read on executors, each failing by itself.

``spark.read.format("feeds").option("sources", json).load()`` gives source, url, fetched (the document, null if it
could not be had) and error (null if it could). ``sources`` is a JSON list of objects with name, type and url. A source of type
``rss`` is fetched by its address (http, https or file); one of type ``premium`` is a stub without credentials and
gives no rows; other types give an error row. ``items`` parses what came, keeps of aggregators' items the first, which
are the newest, and gives a row with an error for a feed that can't be read or parsed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewire.sources.feeds import feed_items

#: Items that are taken of an aggregator's feed. The limit, and what its addresses hold.
AGGREGATOR_ITEMS, AGGREGATOR = 40, "news.google.com"
#: Seconds to wait for a feed, and bytes of it at most.
TIMEOUT, MOST_BYTES = 10, 32 << 20


class _Source(InputPartition):
    def __init__(self, name: str, kind: str, url: str) -> None:
        self.name, self.kind, self.url = name, kind, url


class _Reader(DataSourceReader):
    def __init__(self, sources: list[dict]) -> None:
        self.sources = sources

    def partitions(self) -> list[_Source]:
        return [_Source(s["name"], s.get("type", "rss"), s.get("url", "")) for s in self.sources]

    def read(self, partition: _Source) -> Iterator[tuple]:
        import urllib.request

        if partition.kind == "premium":
            return
        try:
            if partition.kind != "rss":
                raise ValueError(f"no reader for sources of type {partition.kind}")
            with urllib.request.urlopen(partition.url, timeout=TIMEOUT) as answer:
                data = answer.read(MOST_BYTES + 1)
            if len(data) > MOST_BYTES:
                raise ValueError(f"more than {MOST_BYTES} bytes")
            yield partition.name, partition.url, data.decode("utf-8", errors="replace"), None
        except Exception as e:  # whatever a source fails with, the others go on
            yield partition.name, partition.url, None, f"{type(e).__name__}: {e}"[:500]


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "source string, url string, fetched string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("sources", "[]")))


def read_feeds(spark: SparkSession, sources: list[dict]) -> DataFrame:
    spark.dataSource.register(FeedSource)
    if not sources:
        return spark.createDataFrame([], "source string, url string, fetched string, error string")
    return spark.read.format("feeds").option("sources", json.dumps(sources)).load()


def items(feeds: DataFrame, most: int = AGGREGATOR_ITEMS) -> DataFrame:
    """source, position, url, title, content, author, published_at, error; a feed without items has one row if it failed, else none."""
    parsed = feed_items(feeds.filter("error is null").select(F.struct("source", "url").alias("id"), F.col("fetched").alias("xml")))
    capped = parsed.filter(~F.contains("id.url", F.lit(AGGREGATOR)) | (F.col("position") < most))
    rows = capped.select("id.source", "position", "url", "title", "content", "author", "published_at", F.lit(None).cast("string").alias("error"))
    bad = feeds.select("source", F.coalesce("error", F.when(~_well_formed(), F.lit("not a feed"))).alias("error")).filter("error is not null")
    nothing = {"position": "int", "url": "string", "title": "string", "content": "string", "author": "string", "published_at": "timestamp"}
    return rows.unionByName(bad.select("source", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "error"))


def _well_formed():
    """Whether a document is a feed in either form, by its outermost marks."""
    return F.coalesce(F.col("fetched").rlike(r"(?s)<(rss|feed|rdf:RDF)\b.*</(rss|feed|rdf:RDF)>\s*$"), F.lit(False))
