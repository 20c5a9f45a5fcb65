"""Subscribers: a sign-up makes a row unless the address is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signed_up(existing: DataFrame, signups: DataFrame) -> DataFrame:
    """email, created: for each of ``signups`` (email, at) whether it makes a subscriber; of equal addresses, whatever their case, the first does.

    ``existing`` has email; an active or inactive subscriber takes the address.
    """
    known = existing.select(F.lower("email").alias("_known")).distinct()
    first = F.row_number().over(Window.partitionBy(F.lower("email")).orderBy("at", "email")) == 1
    rows = signups.withColumn("_first", first).join(known, F.lower("email") == F.col("_known"), "left")
    return rows.select("email", (F.col("_first") & F.col("_known").isNull()).alias("created"))


def listed(subscribers: DataFrame) -> DataFrame:
    """Active subscribers, the oldest first."""
    return subscribers.filter("is_active").orderBy("created_at", "email")
