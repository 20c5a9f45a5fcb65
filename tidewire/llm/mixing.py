"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place on its source's hash axis (the MD5 of its id). A source that is to give ``target``
words of its ``source_size`` is taken ``floor(target / source_size)`` times as a whole; the rest of the target is met by
the documents below a threshold on the hash axis. The threshold is found without sorting: words are summed by source
and hash bucket, the bucket in which the budget ends is refined by the next digits of the hash, and so on until it
holds one hash value. Thresholds of growing budgets nest, so a larger mix contains the smaller one.

Sources may be of any size: each level is one aggregation with partial sums, of at most ``16 ** DIGITS`` rows a source.

Defined cases: a null text has 0 words; a null source is a source of its own, ordered last; rows with equal ids share
their hash and are taken or left together; an empty table gives an empty result; further columns are ignored by
``plan_mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import words, written

#: Hexadecimal digits of the hash that one level of the histogram looks at.
DIGITS = 3


def hash_place(doc_id: Column) -> Column:
    """A document's place on the hash axis: 32 hexadecimal digits."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Targets per source: shares by weight of the sum of all sizes, stopped at ``max_repeats`` times the own size.

    ``sizes``: source, source_size, a row for each source. Weights are dealt out in turn in code-point order, null
    last. The excess over a stop is shared again by weight, which is a water level: sources in order of
    ``size / weight`` are stopped as long as the level reaches their stop. Returns source, source_size, target,
    epochs (whole passes), rest_num and rest_den (the remaining budget as a fraction, exact).
    """
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sizes.select("source", F.col("source_size").cast("decimal(38,0)").alias("s"), total.cast("decimal(38,0)").alias("total"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = (place % len(weights) + 1).cast("int")
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn).cast("decimal(6,0)"))
    ranked = ranked.withColumn("ratio", F.col("s") * F.element_at(F.array(*(F.lit(math.lcm(*weights) // w) for w in weights)), turn))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    since = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = lambda c: c.cast("decimal(38,0)")
    ranked = ranked.withColumns({"given": F.coalesce(whole(F.sum(F.col("s") * max_repeats).over(before)), F.lit(0)), "w_left": whole(F.sum("w").over(since))})
    ranked = ranked.withColumn("stopped", F.col("s") * max_repeats * F.col("w_left") <= (F.col("total") - F.col("given")) * F.col("w"))
    everyone = Window.partitionBy()
    ranked = ranked.withColumns({
        "num": whole(F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("s") * max_repeats)).over(everyone), F.lit(0))) * F.col("w"),
        "den": F.coalesce(whole(F.sum(F.when(~F.col("stopped"), F.col("w"))).over(everyone)), F.lit(1)),
    })
    ranked = ranked.withColumns({"num": whole(F.col("num")), "den": whole(F.col("den"))})
    epochs = F.when(F.col("stopped"), F.lit(max_repeats)).otherwise(F.floor(F.col("num") / (F.col("den") * F.col("s")))).cast("int")
    return ranked.select(
        "source",
        F.col("s").cast("long").alias("source_size"),
        F.when(F.col("stopped"), (F.col("s") * max_repeats).cast("double")).otherwise(F.col("num").cast("double") / F.col("den").cast("double")).alias("target"),
        epochs.alias("epochs"),
        F.when(F.col("stopped"), F.lit(0)).otherwise(whole(F.col("num")) - epochs * F.col("den") * F.col("s")).cast("decimal(38,0)").alias("rest_num"),
        F.when(F.col("stopped"), F.lit(1)).otherwise(F.col("den")).cast("decimal(38,0)").alias("rest_den"),
    )


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` as ``(sized, plan)``.

    ``sized``: doc_id, source, size. ``plan``, a row for each source: source, source_size, target, epochs, below. A
    document is taken ``epochs`` times, and once more where its ``hash_place`` is less than ``below``.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")), "sized")
    plan = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets")
    # open: sources whose threshold isn't settled, with the prefix of the bucket it lies in and the words before it
    open_ = plan.filter("rest_num > 0").select("source", F.lit("").alias("prefix"), F.lit(0).cast("decimal(38,0)").alias("base"), "rest_num", "rest_den")
    settled = []
    level = 0
    while level * DIGITS < 32 and not open_.isEmpty():
        level += 1
        width = min(level * DIGITS, 32)
        inside = sized.filter("size > 0").withColumn("place", hash_place(F.col("doc_id"))).join(open_.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        inside = inside.filter(F.col("place").startswith(F.col("prefix")))
        buckets = inside.groupBy("source", "base", "rest_num", "rest_den", F.substring("place", 1, width).alias("bucket")).agg(F.sum("size").cast("decimal(38,0)").alias("n"), F.min("place").alias("least"), F.max("place").alias("most"))
        after = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        buckets = buckets.withColumn("after", (F.col("base") + after).cast("decimal(38,0)")).withColumn("before", F.col("after") - F.col("n"))
        at = buckets.filter("after * rest_den > rest_num").withColumn("first", F.row_number().over(Window.partitionBy("source").orderBy("bucket"))).filter("first = 1")
        # a bucket of one hash value goes in where that brings the source nearer to its target
        fits = F.expr("(before * 2 + n) * rest_den <= 2 * rest_num")
        at = at.withColumn("below", F.when(F.col("before") * F.col("rest_den") >= F.col("rest_num"), F.col("bucket")).when(F.col("least") == F.col("most"), F.when(fits, F.concat("least", F.lit("g"))).otherwise(F.col("least"))))
        at = written(at.select("source", "bucket", F.col("before").cast("decimal(38,0)").alias("base"), "rest_num", "rest_den", "below"), "boundary")
        settled.append(at.filter("below is not null").select("source", "below"))
        open_ = at.filter("below is null").select("source", F.col("bucket").alias("prefix"), "base", "rest_num", "rest_den")
    found = settled[0] if settled else plan.select("source", F.lit("").alias("below")).limit(0)
    for more in settled[1:]:
        found = found.unionByName(more)
    found = found.withColumnRenamed("source", "of")
    plan = plan.join(found, plan["source"].eqNullSafe(found["of"]), "left").select("source", "source_size", "target", "epochs", F.coalesce("below", F.lit("")).alias("below"))
    return sized, written(plan, "plan")


def _copies() -> Column:
    return F.col("epochs") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), copies, source."""
    sized, plan = plan_mix(docs, **how)
    plan = plan.withColumnRenamed("source", "of")
    joined = sized.withColumn("place", hash_place(F.col("doc_id"))).join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"), _copies().cast("int").alias("copies"), "source")


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, with their own columns. Texts aren't shuffled by more than the plan's size asks for."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("from"))
    joined = own.join(plan.select("source", "epochs", "below"), F.col("from").eqNullSafe(F.col("source")))
    copies = F.col("epochs") + F.when(hash_place(F.col("id")) < F.col("below"), 1).otherwise(0)
    return joined.select("row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select("row.*")
