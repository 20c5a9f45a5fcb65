"""Quality rules by robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Documents that fail the base rules are rejected. Of the others, each is a vector of five transformed statistics. In
each stratum (language and source; small ones are pooled by language, and judged by all documents' estimate where that
is small as well) centre and covariance are those
of the ``COVERAGE`` share of documents whose covariance has the least determinant, found by concentration steps from
several starts: distances under the present estimate, then the estimate of the nearest share, until the determinant
stops falling. Documents whose Mahalanobis distance from it is beyond a chi-square quantile are rejected.

A step is one aggregation: moments are summed by stratum, start and distance bucket, and the nearest buckets are added
up, so neither a hot source nor the number of documents puts more into one task than ``16 * 80`` rows a stratum and
start. The regularised estimate (``FLOORS`` squared are added to the variances) also exists where a statistic is
constant, as symbols are in clean text.

Only Spark's own functions are used. Defined cases: null and empty texts fail the base rules; null languages and
sources are strata of their own; however few documents there are, each that passes the base rules has an estimate; repeated rows are
documents each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import written
from tidewire.llm.text_stats import text_stats

#: The statistics: log words, log mean word length, log symbols a word, share of repeated lines, share of repeated words.
P = 5
#: Standard deviations that are added to those found, in the order of the statistics.
FLOORS = (0.5, 0.04, 0.03, 0.1, 0.1)
#: Share of the documents that the estimate is made from.
COVERAGE = 0.75
#: Documents that a stratum's own estimate is made from at least.
MIN_STRATUM = 100
#: Concentration steps for all starts, most steps for the best, and the fall of a log determinant that counts.
STEPS, MORE_STEPS, FALL = 3, 12, 1e-3
#: The stratum of all documents.
ALL = "[]"
#: Part of the documents of a normal distribution beyond which a document is an outlier.
TAIL = 1e-5


def chi_square_quantile(share: float, p: int = P) -> float:
    """By Wilson and Hilferty's approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of its texts and base_failed."""
    stats = text_stats(docs, text_col)
    return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> Column:
    """The transformed statistics of a document that has words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n)


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS)]


def _moments() -> list[Column]:
    x = [F.col("x")[i] for i in range(P)]
    return [F.count("*").cast("double").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _inverse(matrix: Column) -> Column:
    """Of a P x P matrix, row by row: struct of the inverse beside the unit matrix (rows of 2 P) and the log determinant."""
    wide = F.array(*(matrix[i * P + j] if j < P else F.lit(float(j - P == i)) for i in range(P) for j in range(2 * P)))
    start = F.struct(wide.alias("m"), F.lit(0.0).alias("logdet"))

    def eliminate(a: Column, k: Column) -> Column:
        m, pivot = a["m"], F.get(a["m"], k * (2 * P + 1))

        def cell(v: Column, x: Column) -> Column:
            i, j = F.floor(x / (2 * P)).cast("int"), x % (2 * P)
            row = F.get(m, k * 2 * P + j) / pivot
            return F.when(i == k, row).otherwise(v - F.get(m, i * 2 * P + k) * row)

        return F.struct(F.transform(m, cell).alias("m"), (a["logdet"] + F.log(pivot)).alias("logdet"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), start, eliminate)


def _estimate(keys: list[str], sums: DataFrame) -> DataFrame:
    """keys, mean, w (inverse of the regularised covariance) and logdet from summed moments."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    cov = [F.col(f"q{min(i, j)}{max(i, j)}") / F.col("n") - mean[i] * mean[j] + F.lit(FLOORS[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(P)]
    out = sums.select(*keys, F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))
    out = out.withColumn("inv", _inverse(F.col("cov")))
    return out.select(*keys, "mean", F.array(*(F.col("inv.m")[i * 2 * P + P + j] for i in range(P) for j in range(P))).alias("w"), F.col("inv.logdet").alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mean under w."""
    z = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1 if i == j else 2) * F.col("w")[i * P + j] * z[i] * z[j]
    return F.greatest(total, F.lit(0.0))


def _bucket() -> Column:
    """Distances to about 6 %, between e**-20 and e**60."""
    return F.greatest(F.lit(-320), F.least(F.lit(960), F.floor(16 * F.log(_distance() + 1e-9)))).cast("int")


def _nearest(keys: list[str], binned: DataFrame, share: float) -> DataFrame:
    """The buckets, nearest first, in which the nearest ``share`` of a key's documents lies."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")
    return binned.withColumns({"_total": total, "_before": before}).filter(F.col("_before") < F.ceil(F.col("_total") * share))


def concentrate(points: DataFrame, estimates: DataFrame, share: float = COVERAGE) -> DataFrame:
    """One concentration step of every stratum and start."""
    keys = ["stratum", "start"]
    binned = points.join(estimates, "stratum").withColumn("bucket", _bucket()).groupBy(*keys, "bucket").agg(*_moments())
    return written(_estimate(keys, _nearest(keys, binned, share).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))), "estimates")


def starts(points: DataFrame) -> DataFrame:
    """Starting estimates: medians with the spreads between quartiles, and the classical moments."""
    quartiles = [F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"k{i}") for i in range(P)]
    sums = written(points.groupBy("stratum").agg(*_moments(), *quartiles), "start-moments")
    spread = [F.pow((F.col(f"k{i}")[2] - F.col(f"k{i}")[0]) / 1.349, F.lit(2)) + FLOORS[i] ** 2 for i in range(P)]
    robust = sums.select("stratum", F.lit("quartiles").alias("start"), F.array(*(F.col(f"k{i}")[1] for i in range(P))).alias("mean"), F.array(*(F.lit(0.0) if i != j else 1 / spread[i] for i in range(P) for j in range(P))).alias("w"), F.lit(0.0).alias("logdet"))
    return robust.unionByName(_estimate(["stratum", "start"], sums.withColumn("start", F.lit("moments"))))


def strata(stats: DataFrame, min_stratum: int = MIN_STRATUM) -> DataFrame:
    """lang, source, stratum (of all documents, where too few are of the language's small sources) for each language and source of the documents that pass the base rules."""
    n = stats.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    few = F.when(F.col("n") < min_stratum, F.col("n"))
    n = n.withColumn("of_lang", F.coalesce(F.sum(few).over(Window.partitionBy("lang")), F.lit(0)))
    own, of_lang = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    return n.select("lang", "source", F.when(F.col("n") >= min_stratum, own).when(F.col("of_lang") >= min_stratum, of_lang).otherwise(ALL).alias("stratum"))


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_stratum: int = MIN_STRATUM, tail: float = TAIL) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, stratum and distance (squared; null where there is no verdict)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = written(base_rules(plain).drop("text"), "text-stats")
    of = written(strata(stats, min_stratum), "strata").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "stratum")
    stats = stats.join(of, stats["lang"].eqNullSafe(of["_lang"]) & stats["source"].eqNullSafe(of["_source"]), "left").drop("_lang", "_source")
    stats = stats.withColumn("stratum", F.when(~F.col("base_failed"), F.col("stratum")))
    points = stats.filter("stratum is not null").select("stratum", vector().alias("x"))
    if not of.filter(F.col("stratum") == ALL).isEmpty():  # the estimate of all is made from all
        points = points.filter(F.col("stratum") != ALL).unionByName(points.withColumn("stratum", F.lit(ALL)))
    points = written(points, "points")
    found = written(starts(points), "starts")
    for _ in range(STEPS):
        found = concentrate(points, found)
    best = found.groupBy("stratum").agg(F.min_by(F.struct("start", "mean", "w", "logdet"), F.struct("logdet", "start")).alias("e")).select("stratum", "e.*")
    for _ in range(MORE_STEPS):
        before, best = best, concentrate(points, best)
        fell = best.join(before.select("stratum", F.col("logdet").alias("was")), "stratum").filter(F.col("was") - F.col("logdet") > FALL)
        if fell.isEmpty():
            break
    # where the median distance is more than a normal distribution's, distances are scaled down to it
    binned = points.join(best, "stratum").groupBy("stratum", _bucket().alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    median = _nearest(["stratum"], binned, 0.5).groupBy("stratum").agg(F.exp((F.max("bucket") + 0.5) / 16).alias("median"))
    final = written(best.join(median, "stratum").select("stratum", "mean", "w", F.greatest(F.lit(1.0), F.col("median") / chi_square_quantile(0.5)).alias("scale")), "final")
    judged = stats.withColumn("x", vector()).join(final, "stratum", "left").withColumn("distance", F.when(F.col("mean").isNotNull(), _distance() / F.col("scale")))
    limit = chi_square_quantile(1 - tail)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"), "stratum", "distance")
