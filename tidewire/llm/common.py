"""What several operators share: words and lines as columns, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that separate words and are stripped from lines.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANKS}+"), "")


def lines(text: Column) -> Column:
    """Lines of a text, split at ``\\n``; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Plain ASCII takes the faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder for its lifetime; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL_FOLDERS.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        _LOCAL_FOLDERS[app] = found
    return found.rstrip("/")


#: Lets Spark delete the shuffle files of a statement when it is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut, lost executors cost nothing.

    The shuffle files behind it aren't needed any more and go at once; the table itself goes by ``released``, and what
    is left of a session's tables lies together under its application id, to be deleted when it is over.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 32 << 20


def if_small(table_: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table_``, a written table, to be broadcast where its rows take at most ``limit`` bytes; else Spark decides."""
    plain = lambda c, kind: F.to_json(F.col(f"`{c}`")) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`")
    texts = [F.sum(F.coalesce(F.octet_length(plain(c, kind)), F.lit(0))) for c, kind in table_.dtypes if kind.startswith(("string", "binary", "array", "map", "struct"))]
    rows, *lengths = table_.agg(F.count("*"), *texts).first()
    return F.broadcast(table_) if rows * 16 * len(table_.columns) + sum(x or 0 for x in lengths) <= limit else table_
