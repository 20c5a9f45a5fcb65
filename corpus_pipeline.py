"""From raw documents to packed training sequences: ``run`` applies ``STAGES`` in order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from tidewire.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learned from the labels outside the held-out quarter, doesn't reject.

    Null and empty texts are scored by zero statistics; repeated rows are decided alike; without labels of both classes
    no document is rejected; an empty table stays empty. All columns stay.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no later document holds as well, where three or more do; a document may end up empty.

    A null text becomes an empty one; rows of a null id keep their lines and count for nobody; rows of one id are one
    document to the counts. Every row stays, with its other columns but for n_chars, which is the new text's.
    """
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link on their shingles, the one of the least id.

    Documents without words link with nothing and all stay; a null id comes last; of rows that share id and text, one
    stays. All columns stay.
    """
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go.

    A null source is a source; documents without words are taken as often as their source's others by their place; rows
    of one id are taken alike. All columns stay; a document that is taken twice is two equal rows.
    """
    return mixing.apply_mix(docs, mixing.plan_mix(docs)[1])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    Documents without words have no piece; equal rows are packed each for itself, and a null id is kept as it is.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: The classifier's fit can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
