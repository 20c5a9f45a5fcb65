"""Snapshots: what a table is after new rows came in. Each function gives the next snapshot; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and the incoming rows of keys that it doesn't have, one for each."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns)
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of known keys get the incoming ``columns`` (all but the keys by default); rows of new keys are added."""
    columns = [c for c in existing.columns if c not in keys] if columns is None else columns
    new = incoming.select(*(F.col(c).alias(f"_{c}") for c in existing.columns), F.lit(True).alias("_in"))
    on = [existing[k].eqNullSafe(new[f"_{k}"]) for k in keys]
    joined = existing.withColumn("_was", F.lit(True)).join(new, on, "full")
    pick = lambda c: F.when(F.col("_was").isNull() | (F.col("_in") if c in columns else F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in keys else pick(c).alias(c) for c in existing.columns))


def replace_part(existing: DataFrame, rebuilt: DataFrame, column: str, value) -> DataFrame:
    """One part of a table built anew: the rest as it was."""
    return existing.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rebuilt.filter(F.col(column).eqNullSafe(F.lit(value))))
