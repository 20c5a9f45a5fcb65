"""Filter interaction audit: what each filter removes in every order of application, from masks of failures.

Every document is tested once against all filters; the mask of those it fails is all that orders depend on. Documents
are counted by part and mask, at most 2^k cells a part for k filters. Each mask that occurs is unpivoted against all
orders' steps, in long form: a running bit-or over the steps of an order holds the filters that a mask has failed
earlier, so the row tells whether the step removes it, meets it again or keeps it. Conditional sums over the cells give
the counts of a part; totals over all orders and steps of a filter, by a window, give its Shapley sum.

Documents are shuffled as (id, digest, mask) rows alone. Cells are pre-aggregated by tasks, so neither a source nor a
text that a third of the rows share meets in one task; the table of orders has at most ``2^k * k! * k`` rows, which
bounds what is broadcast.

Defined cases: a null text is an empty one, a null part an empty string; the first of equal texts is that of the least
id, whose repeated rows are all first; a null id is never first nor later; a document without labels is neither good
nor toxic, one with several rows of labels is either if any row says so; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import if_small, words, written
from tidewire.llm.text_stats import count_chars

#: Filters beyond which all orders are too many rows to be listed.
MAX_FILTERS = 6
_METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def document_filters(text: Column, word_array: Column) -> dict[str, Column]:
    """Failure conditions of the registered query, but for repeated texts: too short, few distinct words, capitals, symbols."""
    n = F.size(word_array)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(word_array)) < 50 * n,
        "C": 100 * count_chars(text, "[A-Z]") > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(x, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(conditions)))


def failures(docs: DataFrame, repeated: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, list[str]]:
    """id, part and mask of every document, and the filters in the order of their bits; ``repeated`` is failed by texts that a smaller id has."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    tests = document_filters(F.col("text"), F.col("words"))
    rows = written(read.select("id", "part", _bits(list(tests.values())).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-masks")
    several = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    later = rows.join(if_small(written(several.select("digest", "first"), "first-texts")), "digest", "left")
    bit = F.when(F.col("id") > F.col("first"), F.lit(1 << len(tests))).otherwise(F.lit(0))
    return later.select("id", "part", F.col("mask").bitwiseOR(bit).alias("mask")), [*tests, repeated]


def cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask."""
    of = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.join(if_small(written(of, "labels")), "id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """number, filter_order, step, filter and bit for every step of every order of ``names``; orders are numbered from 0."""
    if len(names) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters; all orders of more are too many")
    rows = [(number, "".join(p), k + 1, name, 1 << names.index(name)) for number, p in enumerate(permutations(names)) for k, name in enumerate(p)]
    return spark.createDataFrame(rows, "number int, filter_order string, step int, filter string, bit int")


def audit(counted: DataFrame, names: list[str]) -> DataFrame:
    """part, filter_order, step, filter, the counts after each step of each order, and shapley, from ``cells``; bit k of a mask is filter k."""
    spark = counted.sparkSession
    # each mask is unpivoted to all orders' steps: at most 2^k masks, so neither side grows with the data
    steps = orders(spark, names)
    long_form = counted.select("mask").distinct().withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(names)) - 1)))).join(F.broadcast(steps), "number")
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    seen = long_form.withColumns({"fails": fails != 0, "earlier": F.coalesce(F.bit_or(fails).over(before), F.lit(0)) != 0})
    steps_of_masks = written(seen.select("mask", "filter_order", "step", "filter", "fails", "earlier", (F.col("mask") == F.col("bit")).alias("alone")), "mask-steps")
    rows = counted.join(F.broadcast(steps_of_masks), "mask")
    removed = F.col("fails") & ~F.col("earlier")
    total = lambda value, condition: F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("long")
    metrics = (total("n", ~F.col("fails") & ~F.col("earlier")), total("n", removed), total("n", F.col("fails") & F.col("earlier")), total("n", F.col("alone")), total("good", removed), total("toxic", removed))
    by_step = rows.groupBy("part", "filter_order", "step", "filter").agg(*(m.alias(name) for name, m in zip(_METRICS, metrics, strict=True)))
    # a part's and filter's rows are as many as there are orders' steps of it, whatever the data
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five registered filters over ``docs``."""
    masks, names = failures(docs)
    return audit(written(cells(masks, labels), "filter-cells"), names)
