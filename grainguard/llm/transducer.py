"""BPE with word ends as a streaming transducer with bounded lookahead, and an incremental decoder.

What a merge list makes of a prefix can change when more text follows, but only near its end. Let the runs on a
prefix and on its continuation agree left of some border. The border can move left only where, in one of the runs,
a rule merges the token before it with the one behind it; it moves by the left part of that rule. Ranks of such
rules rise, and the left part of each is how the right part of the next begins, for that one starts at the new
border. So no border moves further than the heaviest such chain of rules (``sufficient_lookahead``, one pass over
the merge list from its end). Tokens that end so far before the end of what has been read are stable and are
emitted; the rest is read on from there, as no merge crosses a final border.

A word of any length is coded with a buffer of ``STEP`` symbols, the lookahead and one token. The decoder keeps at
most three bytes of an unfinished character. Only the map side works: no shuffle, so copies and hot sources cost
nothing extra. Besides the row itself, a task holds a block of texts and bounded caches of words and pieces.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainguard.llm.bpe import blocks
from grainguard.llm.columns import without
from grainguard.llm.merging import merge
from grainguard.session import ship

STEP = 4096
CACHED = 200_000
CACHED_LETTERS = 256
# White space as the tokenizers library knows it.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = regex.compile("[" + "".join(map(chr, WHITE)) + "]+")
# White space to Python alone; otherwise both know the same.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def runs_of(text: str) -> list[str]:
    """The runs of a text without white space."""
    return SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """How many symbols before the end of a prefix its tokens may still change; see the head of this module."""
    heaviest: dict[str, int] = {}
    most = 0
    for left, right in reversed(merges):
        weight = len(left) + heaviest.get(left, 0)
        most = max(most, weight)
        ended = bool(end) and right.endswith(end)
        letters = right[: -len(end)] if ended else right
        for k in range(1, len(letters) + (not ended)):
            if heaviest.get(letters[:k], 0) < weight:
                heaviest[letters[:k]] = weight
    return most


class Remembered(dict):
    """Values by key, made when missing. Two generations of ``CACHED`` keys are kept, so frequent ones stay."""

    def __init__(self, make: Callable):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LETTERS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def parts_of(spec: dict, kind: str, inner: str) -> list[dict]:
    part = spec.get(kind) or {"type": "Sequence", inner: []}
    return part[inner] if part["type"] == "Sequence" else [part]


class Transducer:
    """A tokenizer file of the tokenizers library whose words are parted at white space, ready to encode and decode.

    Supported: BPE without dropout, unknown tokens or byte fallback, whose rules only use what earlier ones make; NFC,
    lower case and white-space runs as normalizers; one Split by a pattern followed by ByteLevel; added tokens that
    are neither normalized nor stripped. Anything else is refused.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"}
        if model.get("type") != "BPE" or any(model.get(name) for name in plain):
            raise ValueError("only plain BPE with word ends is supported")
        norms = parts_of(spec, "normalizer", "normalizers")
        if any(n["type"] not in ("NFC", "Lowercase") and n.get("pattern") != {"Regex": r"\s+"} for n in norms):
            raise ValueError("only NFC, Lowercase and white-space runs are supported as normalizers")
        splits = parts_of(spec, "pre_tokenizer", "pretokenizers")
        if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
            raise ValueError("only Split by matches followed by ByteLevel is supported")
        if splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
            raise ValueError("only ByteLevel without a pattern of its own and without a leading blank is supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that match exactly are supported")
        self.lower = any(n["type"] == "Lowercase" for n in norms)
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = {content[0] for content in self.added if content}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(letters)})
        self.symbols = {letter: vocab[letter] for letter in letters}
        self.endings = {letter: vocab[letter + self.end] for letter in letters}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        known = {*letters, *(letter + self.end for letter in letters)}
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            if left not in known or right not in known:
                raise ValueError(f"rule {rank} uses a token that no earlier rule makes")
            known.add(left + right)
            self.pairs[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.tokens = {i: token for token, i in vocab.items()} | {i: token for token, i in self.added.items()}
        self.widths = {i: len(token) - (len(self.end) if self.end and token.endswith(self.end) else 0) for token, i in vocab.items()}

        from tokenizers import Tokenizer  # Unicode tables of the library: its NFC, lower case and letter classes

        own = Tokenizer.from_str(file)
        self.normalize = own.normalizer.normalize_str if own.normalizer else str
        self.split = own.pre_tokenizer.pre_tokenize_str
        self.words = Remembered(lambda word: b"".join(self.encode_word(word)))
        self.pieces = Remembered(lambda piece: b"".join(array("i", ids).tobytes() for ids in self.stable(piece)))

    def stable(self, piece: str) -> Iterator[list[int]]:
        """Token ids of one piece, as soon as nothing that follows can change them."""
        pending: list[int] = []
        for start in range(0, len(piece), STEP):
            pending += map(self.symbols.__getitem__, piece[start : start + STEP])
            if start + STEP >= len(piece):
                pending[-1] = self.endings[piece[-1]]
                yield merge(pending, self.pairs)
                return
            border, emitted, ids = len(pending) - self.lookahead, 0, []
            for i in merge(pending, self.pairs):
                if emitted + self.widths[i] > border:
                    break
                emitted += self.widths[i]
                ids.append(i)
            pending = pending[emitted:]
            yield ids

    def pieces_of(self, word: str) -> Iterable[str]:
        """The pieces of a run without white space, in byte letters."""
        if not word.isascii():
            return (piece for piece, _ in self.split(self.normalize(word)))
        word = word.lower() if self.lower else word
        if not word.isprintable():  # printable ASCII letters stand for themselves
            return (piece.translate(self.letters) for piece in self.pattern.findall(word))
        return self.pattern.findall(word)

    def encode_word(self, word: str) -> Iterator[bytes]:
        """Ids of a run without white space as native 32-bit integers."""
        marked = any(mark in word for mark in self.marks)
        for part in self.specials.split(word) if marked else [word]:
            if part in self.added:
                yield array("i", [self.added[part]]).tobytes()
            else:
                yield from map(self.pieces.__getitem__, self.pieces_of(part))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, word by word."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, runs_of(text))), "i4")


class Decoder:
    """Byte-to-text state machine: takes ids as they come and gives the text that is certain so far.

    With ``words`` it gives the words themselves, parted by one blank; otherwise what the library's ``decode`` gives for
    a file without a decoder, the tokens' own names parted by one blank. Ids that the file doesn't know give
    nothing. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, model: Transducer, words: bool = False):
        self.between = b"" if words else b" "
        self.table: dict[int, bytes] = model.__dict__.setdefault(f"decoding_{words}", {})
        if not self.table:
            raw = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
            for i, token in model.tokens.items():
                if not words:
                    self.table[i] = token.encode()
                elif token in model.added:
                    self.table[i] = token.encode() + b" "
                else:
                    ended = bool(model.end) and token.endswith(model.end)
                    name = token[: -len(model.end)] if ended else token
                    self.table[i] = b"".join(map(raw.__getitem__, name)) + (b" " if ended else b"")
        self.words = words
        self.waiting = b""
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        try:
            found = self.between.join(map(self.table.__getitem__, ids))
        except KeyError:
            ids = [i for i in ids if i in self.table]
            found = self.between.join(map(self.table.__getitem__, ids))
        if not ids:
            return ""
        data = self.waiting + found
        self.waiting = self.between
        if self.words and data.endswith(b" "):
            data, self.waiting = data[:-1], b" "
        return self.utf8.decode(data)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


DECODED_AT_ONCE = 1 << 16


def decoded_text(model: Transducer, ids: list[int], words: bool = False) -> str:
    machine = Decoder(model, words)
    parts = [machine.feed(ids[k : k + DECODED_AT_ONCE]) for k in range(0, len(ids), DECODED_AT_ONCE)]
    return "".join([*parts, machine.close()])


BUILT: dict[str, Transducer] = {}


def transducer_of(file: str, key: str) -> Transducer:
    """One tokenizer per worker process; it outlives a task."""
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = Transducer(file)
    return BUILT[key]


def digest(file: str) -> str:
    return hashlib.sha256(file.encode()).hexdigest()


def encode(docs: DataFrame, file: str, text: str = "text", decoded: str | None = None, words: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), ``n_tokens`` and, if a name is given, that column with the decoded text.

    ``file`` is the content of a tokenizer file. The ids are those of the library's ``encode`` without special tokens
    added; names of added tokens in a text give their ids, as there. A NULL or empty text has no tokens and
    decodes to an empty text. Rows are neither dropped nor merged, so repeated rows repeat. Columns of ``docs`` that have
    one of the added names are replaced. An empty table gives an empty table. A very long text takes the memory of the
    text and its ids; within it, words of any length are streamed.
    """
    spark = docs.sparkSession
    ship(spark)
    added = ["token_ids", "n_tokens"] + ([decoded] if decoded else [])
    kept = without(docs, *added)
    shared = spark.sparkContext.broadcast((file, digest(file)))  # fixed size: a tokenizer file, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer_of(*shared.value)
        for batch in batches:
            for part, texts in blocks(batch, text):
                ids = [model.encode(t) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = [lists, pa.array(np.diff(ends).astype(np.int64))]
                if decoded:
                    columns.append(pa.array([decoded_text(model, i.tolist(), words) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    schema = T.StructType(list(kept.schema.fields)).add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())
    if decoded:
        schema = schema.add(decoded, T.StringType())
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, file: str, name: str = "decoded", words: bool = False) -> DataFrame:
    """``coded`` with the text of its ``token_ids`` in column ``name``; NULL ids decode to an empty text, as do none."""
    spark = coded.sparkSession
    ship(spark)
    kept = without(coded, name)
    shared = spark.sparkContext.broadcast((file, digest(file)))  # fixed size, as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer_of(*shared.value)
        for batch in batches:
            texts = [decoded_text(model, ids or [], words) for ids in batch["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return kept.mapInArrow(run, T.StructType(list(kept.schema.fields)).add(name, T.StringType()))


def digests(coded: DataFrame) -> DataFrame:
    """One row per document: token count, SHA-256 of the decimal ids and of the decoded text."""
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256")
    )
