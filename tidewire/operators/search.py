"""Full-text search over an inverted index: postings by stem, laid out in buckets that a query's terms prune.

``postings`` has one row for each stem of a document, with its places. ``save`` lays them out by a hash of the stem and
sorted by it, so a search reads the buckets of its terms, and within them the pages that may hold them. A document
matches if it has every term of the query that isn't a stop word. Ranks follow the usual measure of a text search with one weight for
all places: a single term ranks by its occurrences, several by how near they stand to each other.

Defined cases: a text is its runs of letters and digits in lower case; null texts have no postings; a query of stop
words alone matches nothing; of a term's places in a document the first 256 count, and no place beyond 16,383 is told
from it, so that ranks stay cheap however long a text is.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.stem import is_stop_word, stems
from tidewire.functions.text import runs
from tidewire.storage.folder import if_small, written

# The weight of a place, the sum of 1/k² over all k, and the most places that count.
WEIGHT, SUM_OF_SQUARES, MOST_PLACES, LAST_PLACE = 0.1, 1.64493406685, 256, 16383
TERM = r"[\p{L}\p{N}]+"
#: Bytes of a vocabulary that is broadcast at most.
SMALL_VOCABULARY = 16 << 20


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _places(text: Column) -> Column:
    """term, n and places (the first of them, in order) of each distinct term of a text that is no stop word, told within its row."""
    placed = F.transform(terms(text), lambda t, i: F.struct(t.alias("term"), F.least(i + 1, F.lit(LAST_PLACE)).alias("place")))
    ordered = F.sort_array(F.filter(placed, lambda x: ~is_stop_word(x["term"])))

    one = lambda r: F.struct(F.get(r, F.lit(0))["term"].alias("term"), F.size(r).cast("long").alias("n"), F.transform(F.slice(r, 1, MOST_PLACES), lambda x: x["place"]).alias("places"))
    return F.transform(runs(ordered, "term"), one)


def _stemmed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """stem, id, n, places of each distinct term of a document; of terms that share a stem each has a row."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(_places(F.col(text_col))).alias("x")).select("id", "x.*")
    # each distinct term is stemmed once; the vocabulary is joined, not computed by row, and where it is small no posting is shuffled for it
    vocabulary = written(stems(docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).distinct().filter(~is_stop_word(F.col("term")))), "vocabulary")
    return each.join(if_small(vocabulary, SMALL_VOCABULARY), "term").select("stem", "id", "n", "places")


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    merged = rows.groupBy(*by, "stem", "id").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return merged.select(*by, "stem", "id", "n", F.slice("places", 1, MOST_PLACES).alias("places"))


def postings(docs: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """stem, id, n (occurrences) and places (the first of them, in order) for each stem of a document; stop words count as places only."""
    return _merged(_stemmed(docs, text_col, id_col))


def bucket_of(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    dealt = rows.withColumns({"bucket": bucket_of(F.col("stem"), buckets), "_part": F.pmod(F.xxhash64("id"), F.lit(4))})
    return dealt.repartition(4 * buckets, "bucket", "_part")


def _put(dealt: DataFrame, path: str) -> None:
    rows = dealt.select("stem", "id", "n", "places", "bucket").sortWithinPartitions("bucket", "stem", "id")
    rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#stem", "true").mode("overwrite").parquet(path)


def save(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes postings by bucket, sorted by stem within it; hot stems spread over several files of their bucket."""
    _put(_dealt(index, buckets), path)


def build(docs: DataFrame, text_col: str, path: str, buckets: int = 64, id_col: str = "id") -> None:
    """``save`` of the ``postings`` of ``docs``; what terms of one stem have is merged where it is dealt to, so that postings are shuffled once."""
    _put(_merged(_dealt(_stemmed(docs, text_col, id_col), buckets), "bucket", "_part"), path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stem string, id long, n long, places array<int>, bucket int").parquet(path)


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems that a query asks for, in order."""
    asked = spark.range(1).select(F.explode(terms(F.lit(query))).alias("term")).filter(~is_stop_word(F.col("term"))).distinct()
    return sorted({r.stem for r in stems(asked).collect()})


def _alone(n: Column) -> Column:
    """Rank of one term with n places."""
    return WEIGHT * F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / (k * k)) / SUM_OF_SQUARES


def _together(places: list[Column]) -> Column:
    """Rank of several terms: every two places of different terms add the less, the farther they are apart."""
    def missed(a: Column, b: Column) -> Column:
        apart = lambda x, y: F.abs(x - y)
        nearness = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        one = lambda x, y: F.when(apart(x, y) == 0, F.lit(1.0)).otherwise(1 - WEIGHT * F.sqrt(nearness(apart(x, y))))
        return F.aggregate(a, F.lit(1.0), lambda s, x: s * F.aggregate(b, F.lit(1.0), lambda t, y: t * one(x, y)))

    out = F.lit(1.0)
    for a, b in combinations(places, 2):
        out = out * missed(a, b)
    return 1 - out


def search(index: DataFrame, query: str, buckets: int = 64) -> DataFrame:
    """id, rank of the documents that have every term of the query; ``index`` as ``load`` gives it."""
    asked = query_stems(index.sparkSession, query)
    if not asked:
        return index.select("id", F.lit(0.0).alias("rank")).limit(0)
    hashed = [bucket_of(F.lit(s), buckets) for s in asked]
    numbers = index.sparkSession.range(1).select(*hashed).first()  # literals, so that the scan is pruned by them
    mine = index.filter(F.col("bucket").isin(sorted(set(numbers))) & F.col("stem").isin(asked))
    of = [F.first(F.when(F.col("stem") == s, F.col("places")), ignorenulls=True).alias(f"p{k}") for k, s in enumerate(asked)]
    matched = mine.groupBy("id").agg(F.count("*").alias("found"), *of).filter(F.col("found") == len(asked))
    rank = _alone(F.size("p0")) if len(asked) == 1 else _together([F.col(f"p{k}") for k in range(len(asked))])
    return matched.select("id", F.round(rank, 6).alias("rank"))
