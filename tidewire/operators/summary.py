"""Extractive summaries: the sentences whose words are the text's most frequent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import once, runs, tokens

# Words that don't count.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "has", "have", "had", "it", "its", "this", "that", "will", "would", "said", "also", "which", "their", "than", "into", "after", "before", "over", "more", "new")


def sentences(text: Column) -> Column:
    """Sentences of a text in order, without blanks around it."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda x: x != "")


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))
    return found.select("id", "pos", F.explode(tokens(F.col("sentence"))).alias("word"))


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """id, word, n of every text without its stop words."""
    return _words(docs, id_col, text_col).filter(~F.col("word").isin(*STOP_WORDS)).groupBy("id", "word").agg(F.count("*").alias("n"))


def summaries(docs: DataFrame, id_col: str = "id", text_col: str = "body", most: int = 3) -> DataFrame:
    """id, summary: the ``most`` sentences whose words come to the highest sum of frequencies, in the order of the text.

    Of equal sentences the earlier wins; a text of two sentences or fewer is its own summary. ``id_col`` tells texts apart.
    """
    number = lambda pos, n: F.struct(pos.alias("pos"), n.cast("long").alias("n"))
    # each column is made once a text, and all of them within its row
    rows = once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "all", sentences(F.col("text")))
    said = F.flatten(F.transform("all", lambda s, pos: F.transform(F.filter(tokens(s), lambda w: ~w.isin(*STOP_WORDS)), lambda w: F.struct(w.alias("word"), pos.alias("pos")))))
    rows = once(rows.select("id", "all"), "same", runs(F.sort_array(said), "word"))
    # a sentence gets the number of each of its words, and nothing for itself
    counted = F.flatten(F.transform("same", lambda r: F.transform(r, lambda x: number(x["pos"], F.size(r)))))
    rows = once(rows, "of", runs(F.sort_array(F.concat(counted, F.transform("all", lambda s, pos: number(pos, F.lit(0))))), "pos")).select("id", "all", "of")
    scored = F.transform("of", lambda r: F.struct((-F.aggregate(r, F.lit(0).cast("long"), lambda n, x: n + x["n"])).alias("score"), F.get(r, F.lit(0))["pos"].alias("pos")))
    best = once(rows, "best", F.sort_array(F.transform(F.slice(F.sort_array(scored), 1, most), lambda x: x["pos"])))
    kept = F.when(F.size("all") <= 2, F.col("all")).otherwise(F.transform("best", lambda pos: F.get("all", pos)))
    return best.select("id", F.array_join(kept, " ").alias("summary"))
