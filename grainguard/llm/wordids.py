"""Ids of whole texts by the tokenizers library, which is asked once for a word that comes again and again.

A byte-level BPE tokenizer parts texts by a pattern whose matches hold a space only at their start or among white space
alone. So a text may be cut before every space that a letter, digit or sign follows: the library's ids of the parts, one
after the other, are its ids of the whole text. Words of ASCII and Latin-1 letters are parted further as the pattern does,
and the library's model merges each distinct piece. Texts with other cuts or with added tokens are encoded whole, and so
are all texts if the file asks for anything else. Words that were seen are kept up to a limit, then only those of the last texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

KEPT_BYTES = 1 << 24  # of words whose ids are kept; half as many of pieces
AT_ONCE, RUNS = 1 << 10, 1 << 16
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = rf"\A[!-~{LETTERS}][\t\n\r!-~{LETTERS}]*\z"
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that byte-level BPE writes as their own characters
SIGNS = {b: b if b in PRINTED else 256 + sum(c not in PRINTED for c in range(b)) for b in range(256)}


def may_be_cut(config: dict) -> bool:
    """Whether the ids of a text are those of its parts: byte-level BPE with its usual pattern and nothing around it."""
    before, after = config.get("pre_tokenizer") or {}, config.get("post_processor") or {}
    return (
        config["model"].get("type") == "BPE" and not config["model"].get("dropout")
        and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        and after.get("type", "ByteLevel") == "ByteLevel"
        and not any(config.get(part) for part in ("normalizer", "truncation", "padding"))
        and not any(" " in token["content"] for token in config.get("added_tokens", []))
    )


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``start``, one after the other."""
    out, done = np.empty(int(size.sum()), pool.dtype), 0
    for i in range(0, len(start), RUNS):  # what is needed between stays small
        part = size[i : i + RUNS]
        ends = np.cumsum(part)
        n = int(ends[-1])
        out[done : done + n] = pool.take(np.repeat(start[i : i + RUNS] - ends + part, part) + np.arange(n))
        done += n
    return out


class Kept:
    """Ids of names, in one array."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.names = pa.concat_arrays([self.names, names])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)

    def coded(self, names: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each name is, and the names that are not kept, which come after those that are."""
        both = pa.chunked_array([self.names, names]).dictionary_encode()
        own = both.chunk(both.num_chunks - 1)
        return own.indices.to_numpy(), own.dictionary.slice(len(self.names))

    def only(self, places: np.ndarray) -> Kept:
        kept, start, size = Kept(), self.start[places], self.size[places]
        kept.add(self.names.take(pa.array(places)), gather(self.pool, start, size), size)
        return kept


def odd(word: str) -> bool:
    """Whether a text may not be cut before this word and the space in front of it."""
    return not word or not ("!" <= word[0] <= "~" or unicodedata.category(word[0])[0] in "LNPS")


def encoded(library: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one text after the other, and how many each has."""
    ids = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def merged(model: Tokenizer, lengths: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for pieces that are words of their own to ``model``, many in one call, told apart by their tokens' ``lengths``."""
    ids, sizes = [], []
    for at in range(0, len(pieces), AT_ONCE):
        own = pieces[at : at + AT_ONCE]
        coded = np.array(model.encode_batch_fast([own], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        ends, wanted = np.cumsum(lengths[coded]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        last = np.searchsorted(ends, wanted)
        if len(ends) and last[-1] == len(ends) - 1 and np.array_equal(ends[last], wanted):
            size = np.diff(last, prepend=-1)
        else:  # signs that the vocabulary lacks
            coded, size = encoded(model, own)
        ids.append(coded)
        sizes.append(size)
    return np.concatenate(ids), np.concatenate(sizes)


class WordIds:
    """Ids of texts as ``encode_batch_fast`` of the library gives them without special tokens."""

    def __init__(self, tokenizer: str):
        config = json.loads(tokenizer)
        self.library, self.cut = Tokenizer.from_str(tokenizer), may_be_cut(config)
        self.added = [token["content"] for token in config.get("added_tokens") or []]
        if self.cut:
            self.merges = Tokenizer.from_str(json.dumps(config | dict.fromkeys(("pre_tokenizer", "post_processor", "decoder")) | {"added_tokens": []}))
            names = self.merges.get_vocab()
            self.lengths = np.zeros(max(names.values()) + 1, np.int64)
            self.lengths[list(names.values())] = list(map(len, names))
        self.words, self.pieces = Kept(), Kept()

    def learn(self, simple: pa.Array, others: pa.Array) -> None:
        """Keep the ids of words, each with a space before it."""
        if len(simple):
            codes, new = self.pieces.coded(pa.array(PIECE.findall(" " + " ".join(simple.to_pylist()))))
            if len(new):
                signs = "\0".join(new.to_pylist()).encode().decode("latin-1").translate(SIGNS | {0: 0})
                self.pieces.add(new, *merged(self.merges, self.lengths, signs.split("\0")))
            sizes = self.pieces.size[codes]
            first = np.flatnonzero(pc.starts_with(self.pieces.names, " ").to_numpy(zero_copy_only=False)[codes])
            self.words.add(simple, gather(self.pieces.pool, self.pieces.start[codes], sizes), np.add.reduceat(sizes, first))
            if self.pieces.names.nbytes > KEPT_BYTES // 2:
                self.pieces = self.pieces.only(np.flatnonzero(np.bincount(codes)))
        if len(others):
            self.words.add(others, *encoded(self.library, [f" {w}" for w in others.to_pylist()]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        if not self.cut or not len(texts):
            return encoded(self.library, texts.to_pylist())
        texts = texts.cast(pa.string())
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        offsets = offsets - offsets[0]
        known = len(self.words.names)
        codes, fresh = self.words.coded(parts.flatten())
        added, simple = np.zeros(len(fresh), bool), pc.match_substring_regex(fresh, SIMPLE).to_numpy(zero_copy_only=False)
        for token in self.added:
            added |= pc.match_substring(fresh, token).to_numpy(zero_copy_only=False)
        simple &= ~added
        uncut = ~simple & ~added
        uncut[uncut] = [odd(word) for word in fresh.filter(pa.array(uncut)).to_pylist()]
        others = ~(simple | added | uncut)
        self.learn(fresh.filter(pa.array(simple)), fresh.filter(pa.array(others)))
        learnt = known + np.concatenate([np.flatnonzero(simple), np.flatnonzero(others)])
        start, size = np.zeros((2, known + len(fresh)), np.int64)
        for own, kept in ((start, self.words.start), (size, self.words.size)):
            own[:known], own[learnt] = kept[:known], kept[known:]
        start, size = start[codes], size[codes]

        # The first word of a text has no space before it. A text that may not be cut everywhere is its own first word.
        heads = offsets[:-1]
        whole = np.zeros(len(heads), bool)
        if uncut.any() or added.any():
            kinds = np.concatenate([np.zeros(known, np.uint8), uncut + 2 * added.astype(np.uint8)])[codes]
            kinds[heads] &= 2
            whole = np.maximum.reduceat(kinds, heads) > 0
            size[np.repeat(whole, np.diff(offsets))] = 0
        firsts = parts.flatten().take(pa.array(heads)).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            firsts[i] = texts[i].as_py()
        ids, own = encoded(self.library, firsts)
        start[heads], size[heads] = self.words.used + np.cumsum(own) - own, own
        out = gather(np.concatenate([self.words.pool[: self.words.used], ids]), start, size), np.add.reduceat(size, heads)
        if self.words.names.nbytes > KEPT_BYTES:
            came = np.ones(len(self.words.names), bool)
            came[:known] = np.bincount(codes, minlength=known)[:known] > 0
            self.words = self.words.only(np.flatnonzero(came))
        return out


@lru_cache(maxsize=1)
def word_ids(tokenizer: str) -> WordIds:
    """One memory of words for all tasks that a worker runs with the same file."""
    return WordIds(tokenizer)
