"""Spelling variants: words one edit from a far more frequent word, found in forward and reversed sorted dictionaries.

Two words are near if one inserted, deleted or replaced code point makes them equal. Of a near pair whose shorter word
has m code points, one edit leaves the first or the last m // 2 of them intact: both words start alike or end alike.
Each word is therefore an entry of the forward dictionary (by its first half) and of the reversed one (by its last
half), with the shorter word's length being its own or one less. Entries are laid out in ranges of their keys, sorted;
a range scan meets the words of one block one after the other and verifies pairs.

A block of more than ``max_block`` entries is subdivided: of the code points that its key leaves open, an edit leaves
half intact again, so every entry goes on with a longer shared prefix and with a longer shared suffix. The open part
halves each time; at one code point the block's words differ in that place alone. A pair is verified in the block that
owns it: of two halves of a block, the one by prefix, unless only the suffix is shared.

Defined cases: null texts have no words, and a null id counts as an empty one; ties of frequency go to the smallest word
in code-point order; an empty table gives no rows; repeated rows count as often as they occur; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import if_small, lower_ascii, released, written

#: A run of Latin letters.
RUN = r"[A-Za-zÀ-ÿ]"
#: Entries of a range partition, on average.
PARTITION_ROWS = 200_000


def damaged_runs(docs: DataFrame, min_chars: int, one_in: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: the runs of all texts in lower case, of which one in ``one_in`` by a checksum of id and run lost a code point; those below ``min_chars`` are left out."""
    # a run shorter than min_chars can't give a longer word
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{min_chars},}})"))).alias("run"))
    hashed = runs.select(lower_ascii(F.col("run")).alias("run"), "id").select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= min_chars)


def vocabulary(words: DataFrame, min_count: int) -> DataFrame:
    """word, n for the words (a column ``word``) that occur ``min_count`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _keyed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, a, b) with ``head``, their first a code points, and ``tail``, their last b reversed."""
    # both are taken at the word's own ends, whether it is the shorter word or the longer one
    return entries.withColumns({"head": F.substring("word", F.lit(1), F.col("a")), "tail": F.substring(F.reverse("word"), F.lit(1), F.col("b"))})


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry with half of the code points that are open, of m - a - b, added to its prefix, and to its suffix."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    step = lambda a, b, by: F.struct((F.col("a") + a).alias("a"), (F.col("b") + b).alias("b"), F.lit(by).alias("by"))
    return entries.withColumn("step", F.explode(F.array(step(half, 0, "p"), step(0, half, "s")))).select("word", "n", "m", F.col("step.a").alias("a"), F.col("step.b").alias("b"), F.concat("path", "step.by").alias("path"))


def _owned(u: str, v: str, m: int, path: str) -> bool:
    """Whether the block reached by ``path`` owns the pair: no block by prefix on the way could have held it."""
    first = 0
    while first < m and u[first] == v[first]:
        first += 1
    a = b = 0
    for by in path:
        half = (m - a - b) // 2
        if by == "p":
            a += half
        elif first >= a + half:
            return False
        else:
            b += half
    return True


def near(u: str, v: str) -> bool:
    """Whether u, no longer than v, becomes v by one edit."""
    if len(v) - len(u) > 1 or u == v:
        return False
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both directions, of the blocks of a sorted range; a block's entries are in one range."""
    at, shorts, longs = None, [], []
    out: tuple[list, list, list, list] = ([], [], [], [])

    def add(u, v, m, path) -> None:
        if near(u[0], v[0]) and _owned(u[0], v[0], m, path):
            for x, y in ((u, v), (v, u)):
                for column, value in zip(out, (x[0], x[1], y[0], y[1]), strict=True):
                    column.append(value)

    def block(m, path) -> None:
        for i, u in enumerate(shorts):
            for v in shorts[i + 1 :]:
                add(u, v, m, path)
            for v in longs:
                add(u, v, m, path)

    def result() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"word": pa.array(out[0], pa.string()), "n": pa.array(out[1], pa.int64()), "other": pa.array(out[2], pa.string()), "other_n": pa.array(out[3], pa.int64())})
        for column in out:
            column.clear()
        return made

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("m", "path", "head", "tail", "word", "n"))
        for m, path, head, tail, word, n in zip(*columns, strict=True):
            key = (m, path, head, tail)
            if key != at:
                if at is not None and len(shorts) + len(longs) > 1:
                    block(at[0], at[1])
                at, shorts, longs = key, [], []
            (shorts if len(word) == m else longs).append((word, n))
        if len(out[0]) > 10_000:
            yield result()
    if at is not None:
        block(at[0], at[1])
    yield result()


def near_pairs(words: DataFrame, max_block: int = 48) -> DataFrame:
    """word, n, other, other_n for every ordered pair of near words of ``words`` (word, n; written, words distinct)."""
    spark = words.sparkSession
    key = ["m", "path", "head", "tail"]
    sized = words.filter(F.length("word") > 0).withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    entries = _halves(sized.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("path")))
    found, used = [], []
    while True:
        now = written(_keyed(entries), "entries")
        used.append(now)
        counts = now.groupBy(*key).agg(F.count("*").alias("members"), F.count_if(F.length("word") == F.col("m")).alias("shorts"), F.any_value(F.col("m") - F.col("a") - F.col("b")).alias("open"))
        blocks = written(counts.filter("members > 1 and shorts > 0"), "blocks")
        used.append(blocks)
        # with one open code point, only true neighbours are left together
        large = (F.col("members") > max_block) & (F.col("open") > 1)
        small_, large_ = (if_small(written(blocks.filter(x).select(key), "block-keys")) for x in (~large, large))
        mine = now.join(small_, key, "left_semi")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-now.count() // PARTITION_ROWS))
        found.append(written(mine.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(_verified, "word string, n long, other string, other_n long"), "near-pairs"))
        if large_.isEmpty():
            break
        entries = _halves(now.join(large_, key, "left_semi").select("word", "n", "m", "a", "b", "path"))
    released(*used)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, if that is ``ratio`` times the word's n or more."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.minus") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = 5) -> DataFrame:
    """``formed`` with ``root``: where forms lead to in the end. Each pass doubles the steps that a word looks ahead."""
    ahead = written(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    # n grows by the ratio with each step, so a chain is logarithmic in the largest n
    while True:
        of = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(ahead.join(if_small(of), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not joined.filter("moved").isEmpty()
        released(ahead)
        ahead = joined.select("word", "root") if not moved else written(joined.select("word", "root"), "roots")
        if not moved:
            return formed.join(if_small(ahead), "word", "left").withColumn("root", F.coalesce("root", "word"))
        released(joined)


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, one_in: int = 199, ratio: int = 5, max_block: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near (near words), form (the far more frequent word that it is taken for, or null), form_n and root (where forms end)."""
    words = written(vocabulary(damaged_runs(docs, min_chars, one_in, id_col, text_col), min_count), "words")
    return roots(written(forms(words, near_pairs(words, max_block), ratio), "forms"))
