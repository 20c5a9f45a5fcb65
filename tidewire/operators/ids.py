"""Surrogate ids: consecutive numbers for new rows, from counts of partitions instead of one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.storage.folder import written


def numbered(rows: DataFrame, order: Sequence[str], start: int = 1, name: str = "id") -> DataFrame:
    """``rows`` with consecutive numbers from ``start`` in order of ``order``, which identifies a row.

    Rows are laid out in ranges and each counts its own; a range begins where the counts before it end. The number is a
    row's place in the whole order, so it is the same on every run, however the ranges fall.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits count within a partition, whose number is above them
    marked = written(placed.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part, nth = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = marked.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + nth + F.lit(start)).drop("_place", "_part", "_before")


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` (id, keys and more) and the incoming rows of unknown keys, with ids after the greatest.

    Of several incoming rows of a key, the one of the least other columns is taken; null keys are keys as well.
    """
    rest = [c for c in existing.columns if c not in ("id", *keys)]
    fresh = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, *(F.col(f"_rest.{c}").alias(c) for c in rest)) if rest else incoming.select(*keys).distinct()
    unknown = fresh.join(existing, [fresh[k].eqNullSafe(existing[k]) for k in keys], "left_anti")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return existing.unionByName(numbered(unknown, list(keys), last + 1).select(*existing.columns))
