"""URL filter: allow and block rules, and a character language-model ratio for the URLs no rule decides.

The URLs that rules allow and block train two variable-order Markov models over characters. A model's estimate
for a character after a context of length *k* is its count there, smoothed by the estimate for the shorter
context, down to a uniform one. A URL's score is the difference of its log-likelihoods under both models per
character; the border is calibrated on the rule-decided URLs, each scored without its own counts.

All of it is aggregates and equi joins of built-in expressions. URLs are made distinct and weighted first, all
lower orders are sums of the table of longest grams, and only that table grows with the data, by its distinct
grams. What is joined is written first, so that Spark knows its size and broadcasts nothing large. The driver
gets the alphabet's totals and the border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import lower_ascii, quoted, stored, without

ORDER = 5
#: Weight of the shorter context's estimate, in characters seen.
PRIOR = 2.0
ALPHABET = 256
#: Scores are grouped to this many steps per unit to find the border.
BINS = 200
PIECE = 1000
# Not in URLs: what stands before and after one.
BEFORE, AFTER = "\x02", "\x03"
SIDES = ("allow", "block")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and where ``://`` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; NULL if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, rest = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame) -> DataFrame:
    """(id, verdict, weight, size, gram): a row per character of each URL and its end, with what precedes it.

    Rows carry the URL's number, not the URL. A URL is cut into pieces that overlap by a context first, as finding a
    place in a text takes as long as the way there.
    """
    bare = F.regexp_replace("url", r"(?s)^.*?://", "")
    padded = F.concat(F.lit(BEFORE * (ORDER - 1)), bare, F.lit(AFTER))
    sized = urls.select("id", "verdict", "weight", padded.alias("p"), (F.length(bare) + 1).alias("size"))
    starts = F.sequence(F.lit(1), F.col("size"), F.lit(PIECE))
    cut = sized.select("id", "verdict", "weight", "p", "size", F.explode(starts).alias("k"))
    cut = cut.select("id", "verdict", "weight", "size", F.substring("p", F.col("k"), F.lit(PIECE + ORDER - 1)).alias("p"))
    placed = cut.select("*", F.explode(F.sequence(F.lit(1), F.length("p") - (ORDER - 1))).alias("i"))
    return placed.select("id", "verdict", "weight", "size", F.substring("p", F.col("i"), F.lit(ORDER)).alias("gram"))


def ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio, ratio_allow, ratio_block): log of allow over block; the latter two without one own count."""
    totals = counted.agg(*(F.sum(s).alias(s) for s in SIDES)).first()
    table = counted
    for k in range(1, ORDER + 1):
        own, before = F.substring("gram", ORDER - k + 1, k), F.substring("gram", ORDER - k + 1, k - 1)
        if k < ORDER:
            sums = counted.groupBy(own.alias(f"__g{k}")).agg(*(F.sum(s).alias(f"g{k}_{s}") for s in SIDES))
            table = table.withColumn(f"__g{k}", own).join(stored(sums, "grams"), f"__g{k}")
        else:
            table = table.withColumns({f"g{k}_{s}": F.col(s) for s in SIDES})
        if k > 1:
            sums = counted.groupBy(before.alias(f"__c{k}")).agg(*(F.sum(s).alias(f"c{k}_{s}") for s in SIDES))
            table = table.withColumn(f"__c{k}", before).join(stored(sums, "grams"), f"__c{k}")

    def log_likelihood(side: str, own: int) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(1, ORDER + 1):
            seen = F.lit(totals[side]) if k == 1 else F.col(f"c{k}_{side}")
            p = (F.greatest(F.col(f"g{k}_{side}") - own, F.lit(0)) + PRIOR * p) / (F.greatest(seen - own, F.lit(0)) + PRIOR)
        return F.log(p)

    allow, block = (log_likelihood(s, 0) for s in SIDES)
    return table.select(
        "gram",
        (allow - block).alias("ratio"),
        (log_likelihood("allow", 1) - block).alias("ratio_allow"),
        (allow - log_likelihood("block", 1)).alias("ratio_block"),
    )


def border(scores: DataFrame) -> float:
    """The score that parts the rule-decided URLs best, by the mean of both sides' shares; 0 if a side is missing."""
    step = F.floor(F.col("score") * BINS)
    sums = scores.where("verdict IS NOT NULL").groupBy(step.alias("step")).agg(
        *(F.sum(F.when(F.col("verdict") == s, F.col("weight")).otherwise(0)).alias(s) for s in SIDES)
    )
    found = sorted(sums.collect(), key=lambda r: r.step)  # bins of a bounded range: log-ratios per character
    allow, block = (sum(r[s] for r in found) for s in SIDES)
    if not allow or not block:
        return 0.0
    best, at, below_allow, below_block = -1.0, 0, 0, 0
    for r in found:
        share = (1 - below_allow / allow + below_block / block) / 2
        if share > best:
            best, at = share, r.step
        below_allow, below_block = below_allow + r.allow, below_block + r.block
    return at / BINS


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    The verdict is the longest fitting rule's, else allow exactly if the score reaches the border. A NULL or
    empty URL has empty parts and is blocked. Equal URLs have equal verdicts; repeated rows stay and count each in
    the models. Columns of ``pages`` with the added names are replaced. An empty table gives an empty table. A long URL
    makes as many rows as it has characters, each of the same few bytes.
    """
    pages = without(pages, *({"host", "path", "rule", "verdict"} - {url}))
    host, path = parts(F.col("url"))
    distinct = pages.where(F.col(quoted(url)).isNotNull()).groupBy(F.col(quoted(url)).alias("url")).agg(F.count(F.lit(1)).alias("weight"))
    parted = distinct.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    numbered = parted.withColumns({"rule": rule, "verdict": verdict, "id": F.monotonically_increasing_id()})
    urls = stored(numbered, "urls")  # written once, so a URL keeps its number

    placed = grams(urls)
    side = lambda s: F.sum(F.when(F.col("verdict") == s, F.col("weight")).otherwise(0)).alias(s)
    counted = stored(placed.groupBy("gram").agg(*(side(s) for s in SIDES)), "grams")
    table = stored(ratios(counted), "ratios")
    part = F.when(F.col("verdict") == "allow", F.col("ratio_allow")).when(F.col("verdict") == "block", F.col("ratio_block"))
    scored = placed.join(table, "gram").groupBy("id", "verdict", "weight", "size").agg(
        F.sum(F.coalesce(part, F.col("ratio"))).alias("total")
    )
    scores = stored(scored.select("id", "verdict", "weight", F.round(F.col("total") / F.col("size"), 9).alias("score")), "scores")
    limit = border(scores)
    own = urls.drop("weight", "verdict").join(scores.select("id", "verdict", "score"), "id")
    judged = own.select(
        F.col("url").alias("__url"), "host", "path", "rule",
        F.coalesce("verdict", F.when((F.col("url") != "") & (F.col("score") >= limit), "allow").otherwise("block")).alias("verdict"),
    )
    out = pages.join(judged, F.col(quoted(url)) == F.col("__url"), "left").drop("__url")
    empty = F.lit("")
    return out.withColumns(
        {"host": F.coalesce("host", empty), "path": F.coalesce("path", empty), "verdict": F.coalesce("verdict", F.lit("block"))}
    )
