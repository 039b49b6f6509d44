"""Personal data: fixed base patterns, and a span classifier trained without labels from labelers that vote.

Base spans are found by their patterns and checks and always stay. Candidates are base matches, matches that
failed their check, and looser shapes (social security numbers, IBANs, local phone numbers, spelt-out mail
addresses). Three labelers vote on each (yes, no or nothing): a *regex* labeler on form and check digits, a
*gazetteer* labeler on known endings, country codes and number ranges, and a *context* labeler on the words
before. Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is; its
posteriors train the final classifier, naive Bayes over span features. A candidate outside the base is added
when the classifier is sure and no check digit or range speaks against it.

All work on texts is built-in expressions on the row itself: nothing is shuffled but counts of vote patterns and
features, of which there are at most a few thousand whatever the input; they are all the driver gets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.llm.arrays import between, blocks, folded, let, pieces
from grainguard.llm.columns import quoted, without

# The base patterns, in the order of their kinds. Atomic groups and the look-behind only spare
# backtracking; they match what the plain forms match.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
}
ORDER = [*KINDS, *LOOSE]
CONTEXT = 32
SURE = 0.95

ENDINGS = "com|net|org|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|mx|ar|cl|co"
IBAN_LANDS = "DE|FR|ES|GB|IT|NL|CH|AT|BE|PT|IE|LU|FI|SE|DK|NO|PL"
CUES = (
    r"(?i)(e-?mail|mail|tel|phone|call|mobile|fax|card|visa|iban|ssn|social|contact|kontakt|karte|konto|anruf"
    r"|courriel|carte|appel|correo|tarjeta|llam|ip|host)[^\n]{0,12}$"
)
COUNTER_CUES = r"(?i)(version|v|release|section|page|isbn|issn|no|nr|id|figure|table|chapter|licen[cs]e|article)[.:\x20#]{0,3}$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits fit."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))
    number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.coalesce(number(c), F.lit(0))) % 97)
    )
    return rest == 1


def check(kind: str, value: Column) -> Column:
    """What decides whether a match of ``kind`` counts; for base kinds, as the contract states it."""
    n = F.length(digits(value))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return (n >= 12) & (n <= 19) & luhn(digits(value))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def gazetteer(kind: str, value: Column) -> Column:
    """1, -1 or 0: whether known endings, lands and number ranges speak for the match."""
    yes = {
        "email": rf"\.(?:{ENDINGS})$", "spelt_email": rf"\.(?:{ENDINGS})$", "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
        "phone": r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])", "iban": rf"^(?:{IBAN_LANDS})",
        "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-2][0-9])\.",
    }
    no = {"ip": r"^(?:0|127|255)\.", "local_phone": r"^\(?[01]", "card": "^0"}
    vote = F.lit(0)
    if kind in yes:
        vote = F.when(value.rlike(yes[kind]), 1).otherwise(vote)
    if kind in no:
        vote = F.when(value.rlike(no[kind]), -1).otherwise(vote)
    return vote


def matches(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value, before) of all leftmost matches; ends are exclusive, in code points."""
    pattern = (PATTERNS | LOOSE)[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m"), m.alias("v"), g.alias("b")))
    spans = F.filter(lengths, lambda x: x["v"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["g"], at + x["g"] + x["m"]
        span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), F.right(x["b"], F.lit(CONTEXT)).alias("before"))
        return end, F.array(span)

    return folded(spans, F.lit(0), "struct<start:int,end:int,value:string,before:string>", step)["out"]


SPAN = "struct<kind:string,start:int,end:int,value:string,base:boolean,valid:boolean,votes:string,features:string>"


def described(kind: str, spans: Column) -> Column:
    """Spans with their check, votes (``regex,gazetteer,context``) and features."""
    def one(s: Column) -> Column:
        valid, base = check(kind, s["value"]), F.lit(kind in KINDS)
        regex = F.when(valid, 1).otherwise(-1)
        context = F.when(s["before"].rlike(CUES), 1).when(s["before"].rlike(COUNTER_CUES), -1).otherwise(0)
        n = F.length(digits(s["value"]))
        size = F.when(n == 0, "0").when(n < 7, "few").when(n < 12, "some").when(n < 20, "many").otherwise("run")
        apart = F.when(s["value"].rlike("[ ().-]"), "parted").otherwise("whole")
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            (base & valid).alias("base"), valid.alias("valid"),
            F.concat_ws(",", regex, gazetteer(kind, s["value"]), context).alias("votes"),
            F.concat_ws(",", F.lit(kind), size, apart, regex, context).alias("features"),
        )

    return F.transform(spans, one)


def candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, all candidates of the row's text in order of start, kind and end."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    some = t.rlike(r"[0-9@]|[\[(][Aa][Tt][\])]")  # no candidate does without
    none = F.array().cast(f"array<{SPAN}>")
    raw = {f"__raw_{k}": F.when(some, matches(t, k)) for k in ORDER}
    df = df.withColumns(raw)
    parts = [F.when(F.size(f"__raw_{k}") > 0, described(k, F.col(f"__raw_{k}"))).otherwise(none) for k in ORDER]
    place = F.create_map(*[x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))])
    ranked = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("s"), place[s["kind"]].alias("k"), s.alias("span")))
    return df.withColumn(out, F.transform(F.sort_array(ranked), lambda r: r["span"])).drop(*raw)


@dataclass
class Model:
    """Sure feature combinations, and what EM found: the prior and each labeler's vote shares per class."""

    probability: dict[str, float]
    prior: float
    reliabilities: list[list[dict[int, float]]]

    def sure(self) -> list[str]:
        return sorted(f for f, p in self.probability.items() if p >= SURE)


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict, float, list]:
    """Posterior per vote pattern, prior, and vote shares per labeler and class; starts from the majority vote."""
    posterior = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in counts}
    prior, shares = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * (1 - posterior[v]) for v, n in counts.items()), sum(n * posterior[v] for v, n in counts.items())]
        prior = (mass[1] + 1) / (sum(mass) + 2)
        shares = []
        for k in range(len(next(iter(counts), ()))):
            shares.append([])
            for c in (0, 1):
                # Labelers are taken to be better than chance: that fixes which class is which.
                seen = {-1: 1.0 + (c == 0), 0: 1.0, 1: 1.0 + (c == 1)}
                for v, n in counts.items():
                    seen[v[k]] += n * (posterior[v] if c else 1 - posterior[v])
                total = sum(seen.values())
                shares[-1].append({vote: x / total for vote, x in seen.items()})
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(s[1][x] / s[0][x]) for s, x in zip(shares, v, strict=True))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, prior, shares


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count vote patterns and features of all candidates of all rows, run EM, train the classifier.

    Rows without candidates, NULL and empty texts add nothing; repeated rows count each. Without any candidate
    the model adds no span.
    """
    found = candidates(docs.select(F.col(quoted(text)).alias("text")), "text", "spans")
    spans = found.select(F.explode("spans").alias("s")).select("s.votes", "s.features")
    rows = spans.groupBy("votes", "features").count().collect()  # votes x features: a bounded set
    counts: dict[tuple[int, ...], int] = {}
    parsed = [(tuple(map(int, r.votes.split(","))), r.features.split(","), r["count"]) for r in rows]
    for votes, _, n in parsed:
        counts[votes] = counts.get(votes, 0) + n
    posterior, prior, shares = expectation_maximisation(counts)
    seen: list[dict[tuple[int, str], float]] = [{}, {}]
    mass = [1.0, 1.0]
    for votes, features, n in parsed:
        for c in (0, 1):
            weight = n * (posterior[votes] if c else 1 - posterior[votes])
            mass[c] += weight
            for i, f in enumerate(features):
                seen[c][i, f] = seen[c].get((i, f), 0.0) + weight
    values = [len({k for k in (*seen[0], *seen[1]) if k[0] == i}) for i in range(5)]
    probability = {}
    for _, features, _ in parsed:
        odds = math.log(mass[1] / mass[0])
        for i, f in enumerate(features):
            p = [(seen[c].get((i, f), 0.0) + 0.5) / (mass[c] + 0.5 * values[i]) for c in (0, 1)]
            odds += math.log(p[1] / p[0])
        probability[",".join(features)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Model(probability, prior, shares)


def find(docs: DataFrame, model: Model, text: str = "text", overlapping: bool = False) -> DataFrame:
    """``docs`` with ``spans``: base spans and those the classifier adds, by start, then kind as listed.

    A span is (kind, start, end, base); positions are code points, ends exclusive. An added span overlaps no base
    span; with ``overlapping``, it may, but does not lie within one. NULL and empty texts have none. A column ``spans`` of ``docs`` is replaced. Empty tables stay empty.
    """
    df = candidates(without(docs, "spans"), text, "__found")
    sure = [F.lit(f) for f in model.sure()] or [F.lit("")]
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    covers = lambda s, b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])
    # Base spans come by start, so of their blocks only those around a span are looked into.
    ranged = lambda block: F.struct(
        F.get(block, F.lit(0))["start"].alias("start"), F.array_max(F.transform(block, lambda b: b["end"])).alias("end"), block.alias("spans")
    )
    base = F.transform(blocks(F.filter("__found", lambda s: s["base"])), ranged)

    def chosen(base: Column) -> Column:
        inside = lambda s: F.exists(base, lambda k: meets(s, k) & F.exists(k["spans"], lambda b: (covers if overlapping else meets)(s, b)))
        stay = F.filter("__found", lambda s: s["base"] | (s["valid"] & s["features"].isin(*sure) & ~inside(s)))
        return F.transform(stay, lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"]))

    return df.withColumn("spans", let(base, chosen)).drop("__found")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets, and overlapping spans, or chains of them,
    by all their kinds (``[IP+CARD]``): nothing that any span covers stays."""
    df = find(docs.withColumnRenamed("spans", "__spans"), model, text, overlapping=True)
    union = "struct<start:int,end:int,kinds:array<string>>"

    def merge(open_: Column, s: Column) -> tuple[Column, Column]:
        """The union that may still grow, and the one before it if this span begins behind its end."""
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s["kind"]).alias("kinds"))
        both = F.struct(
            open_["start"].alias("start"), F.greatest(open_["end"], s["end"]).alias("end"), F.array_union(open_["kinds"], F.array(s["kind"])).alias("kinds")
        )
        grows = open_.isNotNull() & (open_["end"] > s["start"])
        closed = F.when(grows | open_.isNull(), F.array().cast(f"array<{union}>")).otherwise(F.array(open_))
        return F.when(grows, both).otherwise(own), closed

    merged = folded(F.col("spans"), F.lit(None).cast(union), union, merge)
    df = df.withColumn("__apart", let(merged, lambda m: F.concat(m["out"], F.array_compact(F.array(m["carry"])))))
    t = F.col(quoted(text))

    def replaced(parts: Column) -> Column:
        after = lambda s, i: F.concat(
            F.lit("["), F.upper(F.array_join(s["kinds"], "+")), F.lit("]"),
            between(parts, s["end"], F.coalesce(F.get("__apart", i + 1)["start"], F.length(t))),
        )
        first = between(parts, F.lit(0), F.get("__apart", F.lit(0))["start"])
        return F.concat(first, F.array_join(F.transform("__apart", after), ""))

    df = df.withColumn(text, F.when(F.size("__apart") > 0, let(pieces(t), replaced)).otherwise(t)).drop("__apart", "spans")
    return df.withColumnRenamed("__spans", "spans").select(*map(quoted, docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
