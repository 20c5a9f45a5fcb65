"""The folder that the driver and all executors reach, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary one and a cluster must set it."""
    app, found = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.get(app) or _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tidewire-')}")
    return f"{found.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of a statement when it is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of statements within go as soon as these are over."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and lost executors cost nothing.

    The shuffle files behind it go at once; the table itself goes by ``released``, or with the application's folder.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_cleared(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def if_small(table: DataFrame, limit: int) -> DataFrame:
    """``table``, a written table of numbers and strings, to be broadcast where its rows take at most ``limit`` bytes; else Spark decides."""
    texts = [F.sum(F.coalesce(F.octet_length(c), F.lit(0))) for c, kind in table.dtypes if kind == "string"]
    rows, *lengths = table.agg(F.count("*"), *texts).first()
    return F.broadcast(table) if rows * 16 * len(table.columns) + sum(x or 0 for x in lengths) <= limit else table
