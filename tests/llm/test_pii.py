"""Base spans against plain regular expressions, EM against planted reliabilities, added spans, redaction."""

import hashlib
import random
import re

import pytest

from grainguard.llm import pii
from grainguard.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    figures = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(figures)) % 10 == 0


def plain_base(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda n=number: 12 <= len(n) <= 19 and plain_luhn(n),
                "phone": lambda n=number: 9 <= len(n) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TEXTS = [
    None, "", "no data at all", "mail a.b+c@d-e.co.uk, x@y.z%foo@bar.com and @@ a@b", "😀é 10.0.0.255 1.2.3.256 1.2.3.4.5.6.7.8 0001.02.3.4",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1 1 2 3", "+1 (017) 555-7713 +49 30 1234567 +12 +1 2 3", "+4111111111111111 1.1.1.1",
    "a" * 3000 + "@b.c", "1 " * 4000, "9" * 5000, "1.2.3.4." * 900, "+" * 3000 + "1", "x@y." + "z." * 3000, "a@b.c\n" * 300, "١٢٣ ٤٥٦ é@b.de",
]


def test_base_spans(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digests(pii.find(df, pii.fit(df))).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        wanted = plain_base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), (i, got[i], wanted[:9])
        for kind in pii.KINDS:
            assert got[i][f"n_{kind}"] == sum(s.startswith(kind) for s in wanted)
        assert set(wanted) <= set(got[i].spans.split(",")) | {""}


def test_random_texts(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("12 .-+()@ab\n") for _ in range(300))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row in pii.digests(pii.find(df, pii.Model({}, 0.5, []))).collect():
        assert row.spans == ",".join(plain_base(dict(rows)[row.doc_id]))


def test_expectation_maximisation():
    r = random.Random(2)
    truth = [r.random() < 0.4 for _ in range(20000)]
    right = [0.95, 0.8, 0.7]
    counts = {}
    for t in truth:
        v = tuple((1 if t else -1) * (1 if r.random() < p else -1) for p in right)
        counts[v] = counts.get(v, 0) + 1
    posterior, prior, shares = pii.expectation_maximisation(counts)
    assert abs(prior - 0.4) < 0.05
    for share, p in zip(shares, right, strict=True):
        assert abs(share[1][1] - p) < 0.06 and abs(share[0][-1] - p) < 0.06
    assert posterior[1, 1, 1] > 0.9 and posterior[-1, -1, -1] < 0.1


def planted(n):
    r = random.Random(3)
    rows = []
    for i in range(n):
        phone = f"({r.randint(200, 989)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
        rows.append((4 * i, f"You may call {phone} any day"))
        rows.append((4 * i + 1, f"Release {r.randint(1, 9)}.{r.randint(0, 9)} costs {r.randint(10**15, 10**16 - 1)} of these"))
        rows.append((4 * i + 2, f"mail anna{i}@example.com, phone +1 (555) 555-{r.randint(1000, 9999)} please"))
        rows.append((4 * i + 3, "SSN 219-09-9999 and IBAN DE89 3704 0044 0532 0130 00 are his"))
    return rows


def test_added_spans_and_redaction(spark):
    rows = planted(60)
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_email int, spans string")
    model = pii.fit(df)
    out = {r.doc_id: r for r in pii.find(df, model).collect()}
    for d, text in rows:
        kinds = [s.kind for s in out[d].spans]
        if d % 4 == 0:
            assert kinds == ["local_phone"]
        elif d % 4 == 1:
            assert kinds == [s.split(":")[0] for s in plain_base(text)]
        elif d % 4 == 2:
            assert kinds == ["email", "phone"]
        else:
            assert {"ssn", "iban"} >= set(kinds)
    clean = pii.redact(df, model)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] == "You may call [LOCAL_PHONE] any day"
    assert texts[2] == "mail [EMAIL], phone [PHONE] please"
    assert {r.spans for r in clean.collect()} == {"s"}


def test_overlaps_when_redacted(spark):
    df = spark.createDataFrame([(1, "x 1.2.3.4 4111111111111111@a.de y"), (2, None), (3, "none")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(df, pii.fit(df)).collect()}
    assert texts == {1: "x [IP] [EMAIL] y", 2: None, 3: "none"}
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


def iban_with_card():
    """A valid British IBAN whose fourteen digits pass the Luhn check."""
    for account in range(60161331926800, 60161331936800):
        body = "".join(str(int(c, 36)) for c in f"NWBK{account}GB00")
        if plain_luhn(str(account)):
            return f"GB{98 - int(body) % 97:02d}NWBK{account}"


def test_partial_overlaps_when_redacted(spark):
    iban = iban_with_card()
    texts = {
        "a bob@x.com-4111 1111 1111 1111 b": "a [EMAIL+CARD] b",
        "10.0.0.4 111111111111111 b": "[IP+CARD] b",
        "bob@x.com-4111 1111 1111 111 1.2.3.4 b": "[EMAIL+CARD+IP] b",  # a chain: the address meets only the card
        "+378282246310005 é": "[PHONE+CARD] é",
        f"to {iban} now": "to [IBAN+CARD] now",
        "a@b.de 10.0.0.4": "[EMAIL] [IP]",
    }
    sure = {f"iban,{size},whole,1,{c}": 1.0 for size in ("some", "many") for c in (-1, 0, 1)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, pii.Model(sure, 0.5, [])).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("name", ["op6_weak_supervision"])
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(plain_base(docs[r.doc_id])).encode()).hexdigest()


def plain_find(text, sure, overlapping):
    """Added spans by one look at each pair: those that are valid, sure and clear of (or not within) base spans."""
    found = pii_spans[text]
    base = [s for s in found if s.base]
    out = []
    for s in found:
        hit = any((b.start <= s.start and s.end <= b.end) if overlapping else (b.start < s.end and s.start < b.end) for b in base)
        if s.base or (s.valid and s.features in sure and not hit):
            out.append((s.kind, s.start, s.end, s.base))
    return out


pii_spans = {}


@pytest.mark.parametrize("overlapping", [False, True])
def test_added_spans_against_brute_force(spark, overlapping, monkeypatch):
    """Spans over many blocks, base and added ones mixed and overlapping."""
    from grainguard.llm import arrays

    monkeypatch.setattr(arrays, "BLOCK", 5)
    r = random.Random(11)
    bits = ["a@b.de", "10.0.0.4", "4111 1111 1111 1111", "(212) 555-0199", "219-09-9999", "anna (at) x.org", "DE89370400440532013000", "x", "-", " ", "call me", "+1 415 555 0100"]
    rows = [(i, "".join(r.choice(bits) + r.choice((" ", "", "-")) for _ in range(r.choice((1, 8, 60))))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    pii_spans.update({x.text: x.spans for x in pii.candidates(df, "text", "spans").collect()})
    added = 0
    for row in pii.find(df, model, overlapping=overlapping).collect():
        want = plain_find(row.text, set(model.sure()), overlapping)
        assert [tuple(s) for s in row.spans] == want
        added += sum(not s[3] for s in want)
    assert added > 50


def plain_redact(text, spans):
    unions = []
    for kind, start, end, _ in spans:
        if unions and unions[-1][1] > start:
            last = unions[-1]
            unions[-1] = [last[0], max(last[1], end), last[2] + [kind] * (kind not in last[2])]
        else:
            unions.append([start, end, [kind]])
    out, at = "", 0
    for start, end, kinds in unions:
        out, at = out + text[at:start] + "[" + "+".join(k.upper() for k in kinds) + "]", end
    return out + text[at:]


def test_redaction_over_pieces(spark, monkeypatch):
    from grainguard.llm import arrays

    monkeypatch.setattr(arrays, "PIECE", 7)
    monkeypatch.setattr(arrays, "BLOCK", 3)
    r = random.Random(12)
    bits = ["a@b.de", "10.0.0.4", "4111 1111 1111 1111", "é", "wörd 😀", "a@b.de-4111 1111 1111 1111", "\n"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.choice((0, 1, 12, 40))))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    spans = {x.doc_id: [tuple(s) for s in x.spans] for x in pii.find(df, model, overlapping=True).collect()}
    for row in pii.redact(df, model).collect():
        assert row.text == plain_redact(dict(rows)[row.doc_id], spans[row.doc_id])


def test_two_hundred_thousand_addresses(spark):
    import time

    n = 200_000
    text = " ".join(f"u{i}@mail{i % 7}.example.org" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    row = pii.digests(pii.find(df, pii.Model({}, 0.5, []))).first()
    assert row.n_email == n
    clean = pii.redact(df, pii.Model({}, 0.5, [])).first().text
    assert clean == " ".join(["[EMAIL]"] * n)
    assert time.monotonic() - start < 90
