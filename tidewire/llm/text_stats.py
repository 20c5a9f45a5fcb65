"""Statistics of whole texts as columns, in Spark's own functions.

``text_stats`` adds them in a few projections so that the arrays of words and lines are made once a row. Null and
empty texts have zeros. Texts of any length are one row's work in ``n log n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lines, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def count_chars(text: Column, pattern: str) -> Column:
    """Code points that match ``pattern``, a class of characters."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def windows(word_array: Column, n: int) -> Column:
    """Hashes of the windows of ``n`` words, in order; none where there are fewer words."""
    at = lambda i, k: F.get(word_array, i + F.lit(k))
    return F.when(F.size(word_array) < n, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(word_array) - n), lambda i: F.xxhash64(*(at(i, k) for k in range(n)))))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (that have a word), n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_words": words(F.col(text_col)), "_lines": F.filter(lines(F.col(text_col)), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # (hash, place) of each window in order of hash; equal neighbours are windows found twice or more
    out = out.withColumn("_windows", F.array_sort(F.transform(windows(F.col("_words"), 3), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, k: F.get("_windows", k)["h"] == x["h"]
    twice = F.filter("_windows", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce((k > 0) & same(x, F.greatest(k - 1, F.lit(0))), F.lit(False)))
    out = out.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("_words", "_lines", "_windows", "_places")
