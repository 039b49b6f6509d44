"""The prefix trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from grainguard.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, conv string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, sha(f"{len(t[1])}:{t[1]}{t[2]}")))
        own[conv] = [t[1:] for t in turns]
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20 if conv > 0 else -(abs(conv) % 20))
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].split()) if k else 0
        below = children.get(k, [])
        saved[k] = own + sum(saved[c] for c in below)
        leaves[k] = sum(leaves[c] for c in below) if below else 1
    out = []
    for k, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(convs[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(found), len(k), parent, len(found), len(children.get(k, [])), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*row, 5, "clash") for row in rows], SCHEMA).repartition(3)
    found = prefixtrie.conversation_trie(df)
    assert found.columns == COLUMNS
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, found.collect()), key=repr)


def table(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(0, 130), -3, -20, -41, 10**12]:
        if conv == 40:
            continue  # a missing first conversation of its twenty
        n = draw.choice((1, 2, 3, 4, 6, 8, 9, 16, 17, 20))
        rows += [(conv, t, draw.choice(("user", "bot", None)), draw.choice(("Hi there", "a b  c", "", None))) for t in range(n)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "a tie"), (7, 3, "user", "tie"), (8, None, "user", "first"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = table(seed)
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_copies(spark):
    # 600 turns are 75 rows of eight, ten of 64 and two of 512; copies part late, at the very border of a row, or never.
    rows = [(conv, t, "user", f"w{t} x") for conv in (1000, 1020, 1040, 1060) for t in range(600 if conv < 1060 else 512)]
    rows = [(c, t, r, "other" if (c, t) in ((1020, 512), (1040, 63)) else x) for c, t, r, x in rows]
    rows += [(c, t, "user", "same turn") for c in range(2000, 2100) for t in range(3)]
    assert got(spark, rows) == brute(rows)


def test_many_ends_of_a_node(spark, every_key_hot, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PART", 7)
    rows = [(c, t, "user", "same turn") for c in range(300) for t in range(4)]
    assert got(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert got(spark, []) == [] == got(spark, [(None, 1, "user", "x")])
    # Neither has turns after its first h, and there is no conversation to begin with.
    lone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, t, "user", "x") for c in lone for t in range(2)]
    assert got(spark, rows) == brute(rows) == [(lone[0], 0, None, 2, 0, 1, 0, sha(f"{lone[0]},{lone[1]}"))]
