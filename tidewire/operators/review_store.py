"""The review store: new reviews enter in order of arrival, unless one that is held already has the same key or much the same text.

Two texts are much the same if the head of either (its first letters and digits, in lower case) occurs in the other.
Heads are found in texts by hashes of their grams: a head's first gram, of the greatest length in a ladder that the head
has, is looked up among the rolling grams of all texts, and what meets is verified by ``contains``. So the join's rows
are occurrences of heads rather than pairs of reviews. Reviews of equal text are one node; reviews that share a head
meet at that head, not with each other.

The rule is greedy: a review stays unless an earlier one that stays is much the same. It is decided in rounds; in each,
a head carries the earliest review that holds it, decided or not, to all others that hold it.

Defined cases: a review without letters and digits never enters; a null excerpt is such a one; held reviews stay,
whatever they are like; ties of arrival go by id; an empty table of reviews or of held ones is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import dedupe_key, once, squash
from tidewire.storage.folder import if_small, written

#: Characters of a head, and the gram lengths by which heads are looked up.
HEAD, LADDER = 60, (60, 30, 15, 8, 4, 2, 1)
#: Bytes of heads that are broadcast at most.
BROADCAST_BYTES = 8 << 20


def _gram(length: Column) -> Column:
    """The greatest length of the ladder that a head of ``length`` has."""
    out = F.lit(LADDER[-1])
    for step in reversed(LADDER[:-1]):
        out = F.when(length >= step, F.lit(step)).otherwise(out)
    return out


def contained_heads(texts: DataFrame, head: int = HEAD) -> DataFrame:
    """node, head, own: which of the heads of ``texts`` (node, text: distinct, not empty) occur in which texts, and whether it is one's own.

    A head goes by the least node that begins with it, so that what is made of this table holds numbers only.
    """
    heads = texts.select("node", F.substring("text", 1, head).alias("words")).groupBy("words").agg(F.min("node").alias("head"))
    looked_up = written(heads.withColumn("q", _gram(F.length("words"))).select("head", "words", "q", F.xxhash64(F.expr("substring(words, 1, q)")).alias("g")), "heads")
    # texts give grams only of the lengths that heads are looked up by
    lengths = sorted(r[0] for r in looked_up.select("q").distinct().collect())  # at most as many as the ladder has

    def grams_of(q: int) -> Column:
        starts = F.when(F.length("text") >= q, F.sequence(F.lit(1), F.length("text") - (q - 1)))
        # distinct as numbers, since Spark holds structs against each other one by one
        distinct = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(q)))))
        return F.transform(distinct, lambda g: F.struct(F.lit(q).alias("q"), g.alias("g")))

    grams = [grams_of(q) for q in lengths]
    if not grams:
        return texts.select("node", F.col("node").alias("head"), F.lit(True).alias("own"))
    each = texts.select("node", F.explode(F.flatten(F.array_compact(F.array(*grams)))).alias("x")).select("node", "x.q", "x.g")
    # Spark takes an exploded row for one, and would send all grams through the driver where the texts look small
    few = if_small(looked_up, BROADCAST_BYTES)
    met = each.join(looked_up.hint("merge") if few is looked_up else few, ["q", "g"]).select("node", "head", "words")
    return met.join(texts, "node").filter(F.contains("text", "words")).select("node", "head", (F.substring("text", 1, head) == F.col("words")).alias("own"))


def _decided(nodes: DataFrame, holds: DataFrame) -> DataFrame:
    """node, kept: by the greedy rule over ``nodes`` (node, o: order, held) and ``holds`` (node, head, own)."""
    state = written(nodes.select("node", "o", "held", F.when(F.col("held"), F.lit(True)).alias("kept")), "review-state")
    while not state.filter("kept is null").isEmpty():
        met = holds.join(state, "node")
        least = lambda condition: F.min(F.when(condition, F.col("o")))
        kept, open_ = F.col("kept"), F.col("kept").isNull()
        by_head = met.groupBy("head").agg(least(kept).alias("kept_in"), least(open_).alias("open_in"), least(kept & F.col("own")).alias("kept_own"), least(open_ & F.col("own")).alias("open_own"))
        # what holds this review's head, and whose heads it holds
        seen = met.filter("kept is null").join(by_head, "head").groupBy("node").agg(
            F.min(F.least(F.when(F.col("own"), F.col("kept_in")), F.col("kept_own"))).alias("first_kept"),
            F.min(F.least(F.when(F.col("own"), F.col("open_in")), F.col("open_own"))).alias("first_open"),
        )
        joined = state.join(seen, "node", "left")
        new = F.when(kept.isNotNull(), kept).when(F.col("first_kept") < F.col("o"), F.lit(False)).when(F.col("first_open") >= F.col("o"), F.lit(True))
        state = written(joined.select("node", "o", "held", new.alias("kept")), "review-state")
    return state.select("node", "kept")


def admitted(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Those of ``incoming`` (id, url, excerpt, arrived and more) that enter a store that has ``held`` (url, excerpt)."""
    text = squash(F.coalesce("excerpt", F.lit("")))
    key = dedupe_key(F.coalesce("url", F.lit("")), F.coalesce("excerpt", F.lit("")))
    # as a generator's output an excerpt is made once a row
    once_ = lambda rows: once(rows, "_excerpt", F.col("excerpt")).drop("excerpt").withColumnRenamed("_excerpt", "excerpt")
    rows = written(once_(incoming).withColumns({"_text": text, "_key": key, "_o": F.struct(F.col("arrived").alias("at"), F.col("id").alias("id"))}), "incoming-reviews")
    known = written(once_(held).select(text.alias("_text"), key.alias("_key")), "held-reviews")
    # of equal keys the first may enter, and none that is held
    fresh = rows.join(known.select("_key").distinct(), "_key", "left_anti").filter("_text <> ''")
    firsts = fresh.groupBy("_text").agg(F.min("_o").alias("o")).select(F.col("_text").alias("text"), "o", F.lit(False).alias("held"))
    nothing = F.lit(None).cast(firsts.schema["o"].dataType)
    both = firsts.unionByName(known.filter("_text <> ''").select(F.col("_text").alias("text"), nothing.alias("o"), F.lit(True).alias("held")).distinct())
    # a text that is held as well is one node; held ones come before all others
    earliest = F.struct((~F.max("held")).alias("later"), F.min("o").alias("o"))
    nodes = both.groupBy("text").agg(earliest.alias("o"), F.max("held").alias("held"))
    # a node goes by a number from here on: the rounds neither shuffle nor broadcast texts
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "review-nodes")
    decided = _decided(nodes, written(contained_heads(nodes.select("node", "text")), "contained-heads"))
    winners = nodes.join(decided.filter("kept"), "node").filter("not held").select(F.col("text").alias("_text"), F.col("o.o").alias("_o"))
    return fresh.join(winners, ["_text", "_o"], "left_semi").select(*incoming.columns)
