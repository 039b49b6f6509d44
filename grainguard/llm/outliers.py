"""Quality rules as robust multivariate outliers: minimum covariance determinant per language and source.

Each text is reduced, in one scan and by built-in expressions only, to counts that are written once; all later
passes read this narrow copy. Its statistics are transformed to a vector (``FEATURES``), and every group of one
language and source gets the mean and covariance of the 75 % of its texts that lie closest together: from three
starts (median and MAD, all rows, a third of the rows by hash), concentration steps keep the nearest 75 % under
the present estimate and estimate anew; the start with the least determinant wins. A text whose squared
Mahalanobis distance is beyond the cutoff is rejected.

Every step is an aggregate with map-side combination over all rows, so a source with a third of all rows costs
no more than others, and the estimates (a few numbers per group) are joined back at a size Spark knows. Nothing
is sampled, and every group is estimated by itself, however small. What few rows can't tell is taken from the
estimate of the whole language: mean, covariance and unit are mixed with the language's by the weight
n / (n + ``PRIOR_ROWS``) of the group's own n rows. The mixture's covariance holds the way between both means, so
that a small source unlike its language is not rejected as a whole, unless it is of one to three texts. A ridge
as wide as the statistics' own sampling error keeps covariances regular where a statistic hardly varies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import BLANKS, SHINGLE, stored, words

# The base rules and the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEAT_PERCENT = 20

KEPT_SHARE = 0.75
#: What covariances of the nearest 75 % of five normal variables must be multiplied by.
CONSISTENCY = 1.41
#: Median and 0.99999 quantile of the chi-squared distribution with five degrees of freedom.
MEDIAN, CUTOFF = 4.351, 30.86
STEPS = 4
#: Percentiles are exact to one rank in this many.
RANKS = 10_000
#: How many rows of a group weigh as much as the estimate of its language.
PRIOR_ROWS = 100
#: Parts that each group is joined in.
SALTS = 32
#: Sampling error of each feature, the least standard deviation: of one word's length, and of twice the root of a
#: rare count (one in six texts; 1 is the limit for frequent ones), whatever the count is of.
FEATURES = {"x1": 2.5, "x2": 0.75, "x3": 0.75, "x4": 0.75, "x5": 0.75}
NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(df: DataFrame, text: str = "text", *kept: str) -> DataFrame:
    """``kept`` columns with the counts of each text; NULL is an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = rf"[^{BLANKS}]"
    step = df.select(*kept, t.alias("__t"), words(F.col(text)).alias("__w"))
    step = step.select(
        *kept,
        "__w",
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda line: line.rlike(blank)).alias("__lines"),
    )
    last = F.size("__w") - SHINGLE
    window = lambda i: F.xxhash64(*(F.get("__w", i + j) for j in range(SHINGLE)))
    step = step.select(
        *kept,
        "word_chars",
        "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).alias("__h"),
        F.size(
            F.filter(F.sequence(F.lit(0), F.greatest(last + 3, F.lit(0))), lambda i: F.get("__w", i) == F.get("__w", i + 1))
        ).alias("n_twice"),
    )
    # Only texts in which a window repeats go on; their windows are sorted in place, never shuffled.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__s", F.when(F.col("__h").isNotNull() & repeats, pairs)).drop("__h")
    at = lambda i: F.get("__s", i)["h"]
    again = F.filter("__s", lambda e, i: (e["h"] == at(i - 1)) | (e["h"] == at(i + 1)))
    step = step.withColumn("__p", F.sort_array(F.transform(again, lambda e: e["i"]))).drop("__s")
    gaps = F.transform("__p", lambda p, i: F.least(F.coalesce(F.get("__p", i + 1) - p, F.lit(SHINGLE)), F.lit(SHINGLE)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)


def features(counted: DataFrame) -> DataFrame:
    """The transformed vector, each statistic in units in which its sampling error does not depend on the text.

    Mean word length is scaled by the root of the word count, as the mean of few words varies more. Of a count twice
    the root is taken, as that varies alike whatever the count, in proportion to the words up to 100. Repeated words
    come at least two shingles at a time and are counted so, up to 1,000 words: the base rule leaves 20 %, which is
    two such repeats in 100 words, by chance, but 20 in 1,000.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda c, size=1, most=100.0: 2 * F.sqrt(F.col(c) / size * F.least(n, F.lit(most)) / n)
    return counted.select(
        "*",
        ((F.col("word_chars") / n - 5.0) * F.sqrt(F.least(n, F.lit(100.0)))).alias("x1"),
        root("n_symbols").alias("x2"),
        root("n_repeat_words", 2 * SHINGLE, 1000.0).alias("x3"),
        root("n_dup_lines").alias("x4"),
        root("n_twice").alias("x5"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``, language and source, and ``l``, the language alone; no two of their values are equal."""
    name = lambda c: F.concat(F.coalesce(F.length(c), F.lit(-1)), F.lit(":"), F.coalesce(c, F.lit("")))
    return rows.withColumns({"g": F.concat(name("lang"), F.lit("/"), name("source")), "l": name("lang")})


def moments(rows: DataFrame) -> DataFrame:
    """(g, s, mean and covariance of each feature) of the rows of each group and start."""
    mean = [F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES)]
    cov = [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    return rows.groupBy("g", "s").agg(*mean, *cov)


def entry(i: Column | int, j: Column | int) -> Column:
    """Place of row i, column j in a lower triangle laid out row by row."""
    return (F.lit(i) * (F.lit(i) + 1) / 2).cast("int") + F.lit(j)


def over_triangle(value: Callable[[Column, Column, Column], Column]) -> Column:
    """Lower triangle as an array, row by row: each entry is ``value`` of its row, its column and the entries before it."""
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in PAIRS))
    return F.aggregate(places, F.array().cast("array<double>"), lambda done, at: F.concat(done, F.array(value(at["i"], at["j"], done))))


def total(first: Column, last: Column, term: Callable[[Column], Column]) -> Column:
    """Sum of ``term`` over first, ..., last; 0 if there are none."""
    return F.when(first > last, F.lit(0.0)).otherwise(F.aggregate(F.sequence(first, last), F.lit(0.0), lambda sum_, k: sum_ + term(k)))


def factors(estimates: DataFrame, scale: float = CONSISTENCY) -> DataFrame:
    """Means and the inverse Cholesky factor of each covariance with the ridge; ``logdet`` is the determinant's logarithm.

    Twenty-one numbers a group, written at once: what is joined to the rows carries no expression of how it was made.
    """
    cov, low, inverse = F.col("__c"), F.col("__l"), F.col("__w")
    ridge = F.array(*(F.lit(FEATURES[x] ** 2) for x in NAMES))

    def cholesky(i: Column, j: Column, done: Column) -> Column:
        before = total(F.lit(0), j - 1, lambda k: F.get(done, entry(i, k)) * F.get(done, entry(j, k)))
        rest = F.get(cov, entry(i, j)) * scale + F.when(i == j, F.get(ridge, i)).otherwise(0.0) - before
        return F.when(i == j, F.sqrt(rest)).otherwise(rest / F.get(done, entry(j, j)))

    def inverted(i: Column, j: Column, done: Column) -> Column:
        before = total(j, i - 1, lambda k: F.get(low, entry(i, k)) * F.get(done, entry(k, j)))
        return F.when(i == j, 1.0 / F.get(low, entry(i, i))).otherwise(-before / F.get(low, entry(i, i)))

    means = [f"m{i}" for i in range(len(NAMES))]
    df = estimates.select("g", "s", *means, F.array(*(f"c{i}{j}" for i, j in PAIRS)).alias("__c"))
    df = df.select("g", "s", *means, over_triangle(cholesky).alias("__l"))
    df = df.select("g", "s", *means, "__l", over_triangle(inverted).alias("__w"))
    logdet = sum((2 * F.log(F.get(low, F.lit(PAIRS.index((i, i))))) for i in range(len(NAMES))), F.lit(0.0))
    columns = [F.get(inverse, F.lit(t)).alias(f"w{i}{j}") for t, (i, j) in enumerate(PAIRS)]
    return stored(df.select("g", "s", *means, *columns, logdet.alias("logdet")), "factors")


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` joined with their group's estimates, and ``d2``, the squared Mahalanobis distance."""
    # Copies of the few estimates: a group with a third of all rows is joined and summed up in many tasks.
    copies = estimates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = rows.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(copies, ["g", "__salt"]).drop("__salt")
    scaled = (
        sum((F.col(f"w{i}{j}") * (F.col(NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(len(NAMES))
    )
    d2 = sum((F.pow(y, F.lit(2.0)) for y in scaled), F.lit(0.0))
    used = [f"m{i}" for i in range(len(NAMES))] + [f"w{i}{j}" for i, j in PAIRS]
    return df.withColumn("d2", d2).drop(*used, "logdet")


def concentrated(rows: DataFrame) -> DataFrame:
    """(g, mean and covariance): the minimum-covariance-determinant estimate of each group."""
    centre = rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, RANKS).alias(f"m{i}") for i, x in enumerate(NAMES)))
    copies = centre.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    off = rows.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(copies, ["g", "__salt"])
    mad = off.groupBy("g").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(len(NAMES))),
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, RANKS).alias(f"__d{i}") for i, x in enumerate(NAMES)),
    )
    spread = [(F.pow(1.4826 * F.col(f"__d{i}"), F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    starts = mad.select("g", F.lit(0).alias("s"), *(f"m{i}" for i in range(len(NAMES))), *spread)
    whole = moments(rows.withColumn("s", F.lit(1)))
    third = moments(rows.where(F.pmod(F.xxhash64("key"), F.lit(3)) == 0).withColumn("s", F.lit(2)))
    now = factors(starts.unionByName(whole).unionByName(third), 1.0)
    for _ in range(STEPS):
        far = distances(rows, now)
        limits = stored(far.groupBy("g", "s").agg(F.percentile_approx("d2", KEPT_SHARE, RANKS).alias("__q")), "limits")
        near = distances(rows, now.join(limits, ["g", "s"])).where("d2 <= __q")
        found = stored(moments(near), "estimates")
        now = factors(found)
    best = now.groupBy("g").agg(F.min_by("s", F.struct("logdet", "s")).alias("s"))
    return stored(found.join(best, ["g", "s"]), "estimates").drop("s")


def mixed(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, s, mean and covariance) of each group, mixed with its language's; ``sizes`` has g, l and the ``weight``."""
    named = lambda c: f"__{c}"
    language = found.select(*(F.col(c).alias(named(c)) for c in found.columns))
    df = found.join(sizes, "g").join(language, F.col("l") == F.col("__g"))
    w = F.col("weight")
    mix = lambda c: w * F.col(c) + (1 - w) * F.col(named(c))
    way = lambda i: F.col(f"m{i}") - F.col(f"__m{i}")
    means = [mix(f"m{i}").alias(f"m{i}") for i in range(len(NAMES))]
    return df.select("g", F.lit(0).alias("s"), *means, *((mix(f"c{i}{j}") + w * (1 - w) * way(i) * way(j)).alias(f"c{i}{j}") for i, j in PAIRS))


def estimate(rows: DataFrame) -> DataFrame:
    """Estimate per group, mixed with its language's, with ``unit``: what its distances are divided by."""
    own = rows.select("g", "l", "key", *NAMES)
    n = F.col("count")
    sizes = own.groupBy("g", "l").count().select("g", "l", (n / (n + PRIOR_ROWS)).alias("weight"))
    # A language is a group of itself.
    languages = sizes.select("l").distinct().select(F.col("l").alias("g"), "l", F.lit(1.0).alias("weight"))
    sizes = stored(sizes.unionByName(languages), "sizes")
    both = own.unionByName(own.withColumn("g", F.col("l"))).drop("l")
    now = factors(mixed(concentrated(both), sizes))
    units = distances(both, now).groupBy("g").agg(
        F.greatest(F.percentile_approx("d2", 0.5, RANKS) / MEDIAN, F.lit(1.0)).alias("unit")
    )
    units = stored(units, "units")
    language = units.select(F.col("g").alias("l"), F.col("unit").alias("__unit"))
    units = units.join(sizes, "g").join(language, "l")
    units = units.select("g", (F.col("weight") * F.col("unit") + (1 - F.col("weight")) * F.col("__unit")).alias("unit"))
    return stored(now.join(units, "g"), "estimates").drop("s")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, content, the counts, base_failed, distance, kept) of every row.

    ``docs`` needs the columns ``lang`` and ``source`` besides; NULLs there are a group of their own. A NULL or
    empty text has no words and fails the base rule; such rows do not enter the estimates. Repeated rows count
    each. ``content`` is a hash of text, language and source: rows that agree in key and content have one verdict.
    ``distance`` is NULL where the base rule already rejects. An empty table gives an empty result.
    """
    named = docs.select(
        F.col(key).alias("doc_id"), "lang", "source", F.col(text).alias("__text"),
        F.xxhash64(F.col(text), F.col("lang"), F.col("source")).alias("content"),
    )
    counted = counts(named, "__text", "doc_id", "lang", "source", "content")
    counted = counted.withColumns({"base_failed": base_failed(), "key": F.xxhash64("doc_id", "content")})
    rows = stored(grouped(features(counted)), "statistics")
    passing = rows.where("NOT base_failed")
    estimates = estimate(passing)
    wide = rows.join(estimates.select(F.col("g").alias("__g")), F.col("g") == F.col("__g"), "left_anti")
    far = distances(rows, estimates.withColumnRenamed("unit", "__unit")).withColumn("distance", F.col("d2") / F.col("__unit"))
    out = ["doc_id", "content", *COUNTS, "base_failed", "distance"]
    both = far.select(*out).unionByName(wide.withColumn("distance", F.lit(None).cast("double")).select(*out))
    both = both.withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    return both.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def keep_inliers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns are unchanged."""
    bad = judge(docs, key, text).where("NOT kept")
    bad = stored(bad.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct(), "rejected")
    content = F.xxhash64(F.col(text), F.col("lang"), F.col("source"))
    # The list grows with the documents, so it is never broadcast: one plan at every size.
    return docs.join(bad.hint("merge"), F.col(key).eqNullSafe(F.col("__id")) & (content == F.col("__content")), "left_anti")
