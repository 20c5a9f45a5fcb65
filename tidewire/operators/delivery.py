"""Sending an edition: whether it is due, who gets it, and what an attempt leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Local time is three hours ahead; sending begins at nine and is given up at two in the afternoon.
OFFSET, SEND_HOUR, GIVE_UP_HOUR, MAX_ATTEMPTS = "INTERVAL 3 HOURS", 9, 14, 5


def local_time(now: Column) -> Column:
    return now + F.expr(OFFSET)


def due(moments: DataFrame, sent_days: DataFrame, now_col: str = "now") -> DataFrame:
    """``moments`` with reason (early, late, sent or due) and due; ``sent_days``: day, of editions that were sent, in local time."""
    local = local_time(F.col(now_col))
    days = sent_days.select(F.col("day").alias("_day")).distinct()
    rows = moments.join(days, local.cast("date") == F.col("_day"), "left")
    reason = F.when(F.hour(local) < SEND_HOUR, "early").when(F.hour(local) >= GIVE_UP_HOUR, "late").when(F.col("_day").isNotNull(), "sent").otherwise("due")
    return rows.withColumn("reason", reason).withColumn("due", F.col("reason") == "due").drop("_day")


def opened(deliveries: DataFrame, subscribers: DataFrame, edition_id: int) -> DataFrame:
    """``deliveries`` (subscriber_id, edition_id, status, attempts) and a pending one for each active subscriber without one for the edition."""
    known = deliveries.filter(F.col("edition_id") == edition_id).select("subscriber_id")
    new = subscribers.filter("is_active").select(F.col("id").alias("subscriber_id")).join(known, "subscriber_id", "left_anti")
    return deliveries.unionByName(new.select("subscriber_id", F.lit(edition_id).cast("long").alias("edition_id"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts")))


def attempted(deliveries: DataFrame, subscribers: DataFrame, failures: DataFrame) -> DataFrame:
    """``deliveries`` after an attempt at those that aren't sent, have attempts left and an active subscriber; ``failures``: subscriber_id of addresses that fail."""
    active = subscribers.filter("is_active").select(F.col("id").alias("subscriber_id"), F.lit(True).alias("_active"))
    failing = failures.select("subscriber_id").distinct().withColumn("_fails", F.lit(True))
    rows = deliveries.join(active, "subscriber_id", "left").join(failing, "subscriber_id", "left")
    tried = (F.col("status") != "sent") & (F.col("attempts") < MAX_ATTEMPTS) & F.col("_active").isNotNull()
    status = F.when(tried, F.when(F.col("_fails").isNotNull(), "failed").otherwise("sent")).otherwise(F.col("status"))
    return rows.select("subscriber_id", "edition_id", status.alias("status"), (F.col("attempts") + tried.cast("long")).alias("attempts"))
