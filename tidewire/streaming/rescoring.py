"""Rescoring as a stream: articles that turn out to be duplicates raise the score of their original, whenever they come.

Each micro-batch of articles becomes (group, source) members of a versioned table, and the groups that it touches are
scored anew. Both changes are committed under the batch's label: a batch that comes again after a failure finds its
members there, and repeats the scores only if these weren't committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidewire.functions.scoring import confidence, importance
from tidewire.storage.folder import written
from tidewire.storage.versions import VersionedTable
from tidewire.streaming.intake import into


class Rescoring:
    """State at ``path``; ``sources`` (id, trust_weight) is a static table."""

    def __init__(self, spark: SparkSession, path: str, sources: DataFrame, partitions: int = 8, name: str = "rescoring") -> None:
        self.name, self.sources = name, sources
        # a group's rows share a partition, so that it is scored within it
        self.members = VersionedTable(spark, f"{path}/members", StructType.fromDDL("article_group long, source_id long, original boolean"), ["article_group"], partitions)
        self.scores = VersionedTable(spark, f"{path}/scores", StructType.fromDDL("id long, n_sources long, confidence double, importance double"), ["id"], partitions)

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of articles (id, source_id, is_duplicate, duplicate_of_id); an article's latest row counts."""
        label = f"{self.name}-{number}"
        if self.scores.committed(label):
            return
        came = written(batch.select(F.coalesce("duplicate_of_id", "id").alias("article_group"), "source_id", (~F.col("is_duplicate")).alias("original")).distinct(), "members")
        if came.isEmpty():
            return
        merge = lambda old: old.unionByName(came).groupBy("article_group", "source_id").agg(F.bool_or("original").alias("original"))
        self.members.change(came, merge, label)
        touched = came.select("article_group").distinct()
        now = self.members.read().join(touched, "article_group").join(self.sources.select(F.col("id").alias("source_id"), "trust_weight"), "source_id", "left")
        # groups whose original hasn't come have no row to score yet; a source counts once
        summed = now.groupBy("article_group").agg(F.count("trust_weight").alias("n_sources"), F.round(F.avg("trust_weight"), 6).alias("mean"), F.bool_or("original").alias("original")).filter("original and n_sources > 0")
        scored = summed.withColumn("confidence", confidence(F.col("n_sources"), F.col("mean"))).select(F.col("article_group").alias("id"), "n_sources", "confidence", importance(F.col("confidence"), F.col("n_sources")).alias("importance"))
        self.scores.upsert(written(scored, "scores"), label)

    def run(self, articles: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that feeds a stream of articles through ``step``."""
        return into(articles, self.step, checkpoint)
