"""Layouts for lookups: rows sorted by id in ranges, so that statistics and Bloom filters leave few row groups to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a row group: small enough that a lookup reads little, large enough that columns still compress.
ROW_GROUP = 8 << 20


def save_sorted(rows: DataFrame, path: str, id_col: str = "id", partitions: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Writes ``rows`` in ranges of ids, sorted; unsorted keys that are looked up as well can be given Bloom filters by options."""
    ranged = rows.repartitionByRange(partitions, id_col) if partitions else rows.repartitionByRange(id_col)
    writer = ranged.sortWithinPartitions(id_col).write.option("parquet.block.size", row_group).option(f"parquet.bloom.filter.enabled#{id_col}", "true")
    writer.mode("overwrite").parquet(path)


def by_ids(spark: SparkSession, path: str, schema: StructType, ids: Sequence[int], id_col: str = "id") -> DataFrame:
    """Rows of a few ids, by a pushed filter; none for no ids."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col(id_col).isin(list(ids))) if ids else rows.limit(0)
