"""The streaming transducer against the tokenizers library, and its decoder piece by piece."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainguard.llm import transducer
from grainguard.llm.transducer import Decoder, Transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as handle:
    FILE = handle.read()
LIBRARY = Tokenizer.from_file(PATH)
MODEL = Transducer(FILE)
TEXTS = [
    None, "", " ", "a", "Hello  World's END\n\n they'LL", "été ÇA é 日本語 🙂🙂 x" * 5, "zzzzqqqq" * 300, "0123456789" * 30,
    " \t\r\n　\x85" * 5, "<|endoftext|> a<|startoftext|>b <|endoftext", "İΣΑΣ ǅ ß ẞ", "\x1c\x00a\x7f", "aaaaaaaab" * 40, "it's--'s ''ve 'd",
]
SCHEMA = "doc_id long, text string, n_tokens string, extra int"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own(text):
    return MODEL.encode(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert own(text) == ids_of(text)


def test_every_blank_and_letter():
    for code in [*range(0x3100), 0xFEFF, 0x1F600]:
        text = f"a{chr(code)}b"
        assert own(text) == ids_of(text), hex(code)


@pytest.mark.parametrize("letters", ["ab", "aeinrst", "theinro", "abcdefghijklmnopqrstuvwxyz", "éèaß"])
def test_long_words_in_small_steps(letters, monkeypatch):
    monkeypatch.setattr(transducer, "STEP", 16)
    draw = random.Random(7)
    for n in (1, 15, 16, 17, 500, 3000):
        word = "".join(draw.choices(letters, k=n))
        assert own(word) == ids_of(word)
        MODEL.words.clear()
        MODEL.pieces.clear()


def test_buffer_stays_bounded():
    longest, merge = 0, transducer.merge

    def watched(ids, pairs):
        nonlocal longest
        longest = max(longest, len(ids))
        return merge(ids, pairs)

    transducer.merge = watched
    try:
        word = "".join(random.Random(3).choices("etaoinshr", k=200_000))
        ids = [i for part in MODEL.stable(word) for i in part]
    finally:
        transducer.merge = merge
    assert ids == ids_of(word)
    assert longest <= transducer.STEP + MODEL.lookahead + max(MODEL.widths.values())


def test_lookahead_of_a_known_list():
    # Behind "abc" the rule b+c waits for what c becomes, and a+b for what b becomes.
    assert transducer.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], "") == 3
    assert transducer.sufficient_lookahead([("a", "b"), ("b", "c"), ("c", "d")], "") == 1


def test_rules_out_of_order_are_refused():
    import json

    spec = json.loads(FILE)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        Transducer(json.dumps(spec))


@pytest.mark.parametrize("step", [1, 2, 7])
def test_decoder_in_parts(step):
    for text in TEXTS:
        ids = ids_of(text)
        machine = Decoder(MODEL)
        got = "".join(machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + machine.close()
        assert got == LIBRARY.decode(ids, skip_special_tokens=False)
        machine = Decoder(MODEL, words=True)
        got = "".join(machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + machine.close()
        assert got == transducer.decoded_text(MODEL, ids, words=True)
    assert transducer.decoded_text(MODEL, ids_of("Été  日本語"), words=True) == "été 日本語"
    assert transducer.decoded_text(MODEL, [10**6, -1]) == ""


def test_frames(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS + TEXTS)]
    coded = transducer.encode(spark.createDataFrame(rows, SCHEMA), FILE, decoded="decoded")
    assert coded.columns == ["doc_id", "text", "extra", "token_ids", "n_tokens", "decoded"]
    found = {r.doc_id: r for r in coded.collect()}
    assert len(found) == len(rows)
    for i, text, _, _ in rows:
        ids = ids_of(text)
        assert found[i].token_ids == ids and found[i].n_tokens == len(ids)
        assert found[i].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    again = transducer.decode(coded.drop("text"), FILE, "back").collect()
    assert all(r.back == found[r.doc_id].decoded for r in again)
    assert transducer.encode(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def test_query_against_the_library(spark):
    from grainguard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op11_streaming_transducer"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = ids_of(doc.text)
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_patterns_run_only_where_they_can_match(monkeypatch):
    used = []

    class Watched:
        def __init__(self, name, pattern):
            self.name, self.pattern = name, pattern

        def split(self, text):
            used.append((self.name, text))
            return self.pattern.split(text)

    monkeypatch.setattr(transducer, "SPACE", Watched("space", transducer.SPACE))
    monkeypatch.setattr(MODEL, "specials", Watched("specials", MODEL.specials))
    for text in ("plain words　 of unseenplainword", "x<|endoftext|>unseeny\x85b", "a\x1cb c\x1f d"):
        assert own(text) == ids_of(text)
    assert used == [("specials", "x<|endoftext|>unseeny"), ("space", "a\x1cb c\x1f d")]


def test_unknown_ids_decode_to_nothing():
    ids = ids_of("one two")
    assert transducer.decoded_text(MODEL, [-1, *ids, 10**8]) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert transducer.decoded_text(MODEL, [-1]) == ""
