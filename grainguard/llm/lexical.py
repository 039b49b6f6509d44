"""Ranked lexical search for many queries at once, sharing what they have in common.

The query items are a stated set, taken in blocks of bounded size. On the driver the term sets of a block are mined:
terms that the very same items hold become one node, then the pair of nodes that most items hold together, and so on,
until no pair is shared. The result is a DAG from terms over shared sets to items. Two passes over the documents
follow, both on the map side: one counts documents, words and the documents of each query term; the other makes, per
block of documents, a matrix of accumulators, one row per node: the rows of terms from the documents' counts, those of
shared sets as the sum of their children, each once, and the items' scores from what they share. A task keeps the best
documents per item, so at most that many rows per item and task are shuffled. All scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainguard.llm.hashing import text_blocks
from grainguard.session import ship

BLOCK_ITEMS = 4096
BLOCK_ITEM_BYTES = 16 << 20
MATRIX_BYTES = 64 << 20
LEAST_COLUMNS = 16
MINED_NODES = 64
SALTS = 64
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.translate(FOLD).split()


def shared_sets(items: list[set[int]], terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """(children of each inner node, numbered from ``terms`` on; children of each item): every item's leaves are its terms, each once.

    Pairs are mined among the ``MINED_NODES`` most shared nodes of each item, which bounds the work; which sets are
    shared changes the cost only.
    """
    nodes: list[list[int]] = []
    holders: dict[int, set[int]] = defaultdict(set)
    for k, held in enumerate(items):
        for term in held:
            holders[term].add(k)
    alike: dict[frozenset[int], list[int]] = defaultdict(list)
    for term, where in holders.items():
        alike[frozenset(where)].append(term)
    for where, group in alike.items():
        if len(group) > 1 and len(where) > 1:
            node = terms + len(nodes)
            nodes.append(sorted(group))
            holders[node] = set(where)
            for term in group:
                del holders[term]
    parts: list[set[int]] = [set() for _ in items]
    for node, where in holders.items():
        for k in where:
            parts[k].add(node)

    def most_shared(held: set[int]) -> list[int]:
        shared = (n for n in held if len(holders[n]) > 1)
        return sorted(heapq.nlargest(MINED_NODES, shared, key=lambda n: (len(holders[n]), -n)))

    pairs = Counter(pair for held in parts for pair in combinations(most_shared(held), 2))
    queue = [(-n, a, b) for (a, b), n in pairs.items() if n > 1]
    heapq.heapify(queue)
    while queue:
        n, a, b = heapq.heappop(queue)
        both = holders[a] & holders[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # fewer by now, as some hold a larger set instead
            heapq.heappush(queue, (-len(both), a, b))
            continue
        node = terms + len(nodes)
        nodes.append([a, b])
        holders[node] = both
        fresh: Counter[int] = Counter()
        for k in both:
            parts[k] -= {a, b}
            fresh.update(most_shared(parts[k]))
            parts[k].add(node)
        holders[a] -= both
        holders[b] -= both
        for other, shared in fresh.items():
            if shared > 1:
                heapq.heappush(queue, (-shared, other, node))
    return nodes, [sorted(held) for held in parts]


class Search:
    """One block of items, weighed and ready to score documents. ``items`` maps an item's id to its terms."""

    def __init__(self, items: dict, found: dict[bytes, int], documents: int, words: int):
        self.documents, self.words = documents, words
        weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in found.items() if n}
        weights = {t: w for t, w in weights.items() if w > 0}
        self.number = {t: i for i, t in enumerate(sorted(weights))}
        self.weight = np.array([weights[t] for t in sorted(weights)], np.int64)
        asked = {item: {self.number[t] for t in own if t in self.number} for item, own in items.items()}
        self.items = [item for item, own in asked.items() if own]
        inner, tops = shared_sets([asked[item] for item in self.items], len(self.number))
        self.nodes = len(self.number) + len(inner)
        depth = [0] * self.nodes
        levels: dict[int, list[int]] = defaultdict(list)
        for k, children in enumerate(inner, len(self.number)):
            depth[k] = 1 + max(depth[c] for c in children)
            levels[depth[k]].append(k)
        self.levels = [
            (np.array(nodes), *flat(inner[n - len(self.number)] for n in nodes)) for _, nodes in sorted(levels.items())
        ]
        self.top = flat(tops)
        rows = self.nodes + max([len(self.top[0]), *(len(children) for _, children, _ in self.levels)])
        self.columns = max(LEAST_COLUMNS, MATRIX_BYTES // (8 * max(1, rows)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Items by documents."""
        nodes, columns, counts, lengths = [], [], [], []
        for d, text in enumerate(texts):
            own = terms_of(text)
            lengths.append(len(own))
            seen = Counter(own)
            hits = [t for t in seen if t in self.number]
            nodes += [self.number[t] for t in hits]
            counts += [seen[t] for t in hits]
            columns += [d] * len(hits)
        node, column, tf = (np.array(x, np.int64) for x in (nodes, columns, counts))
        m = 50 + 50 * np.array(lengths, np.int64) * self.documents // max(self.words, 1)
        sums = np.zeros((self.nodes, len(texts)), np.int64)
        sums[node, column] = self.weight[node] * (1_000_000_000 * tf // (1000 * tf + 20 * m[column]))
        for own, children, starts in self.levels:
            sums[own] = np.add.reduceat(sums[children], starts, axis=0)
        return np.add.reduceat(sums[self.top[0]], self.top[1], axis=0)


def flat(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All lists (none of them empty) behind each other, and where each begins."""
    lists = list(lists)
    lengths = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.int64), np.cumsum(lengths) - lengths


class Best:
    """The best documents per item seen so far; ties go to the smaller id, NULL last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, is NULL, id
        self.limit = 4 * items * top

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        fresh = (item, scores[item, column], absent[column], ids[column])
        self.rows = [np.concatenate(pair) for pair in zip(self.rows, fresh, strict=True)]
        if len(self.rows[0]) > self.limit:
            self.shrink()

    def shrink(self) -> None:
        item, score, absent, ids = self.rows
        order = np.lexsort((ids, absent, -score, item))
        ordered = item[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]
        self.rows = [column[order[place < self.top]] for column in self.rows]


def ranked(part: list[Column], top: int, rows: DataFrame) -> DataFrame:
    place = Window.partitionBy(*part).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def count_terms(docs: DataFrame, text: str, wanted: frozenset[bytes]) -> tuple[dict[bytes, int], int, int]:
    """(documents of each wanted term, documents with a term, words in all); what comes back is as long as ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found, documents, words = shared.value, Counter(), 0, 0
        for batch in batches:
            for _, texts in text_blocks(batch, text):
                for raw in texts:
                    own = terms_of(raw)
                    documents += bool(own)
                    words += len(own)
                    found.update(asked.intersection(own))
        terms = [None, *found]
        columns = [pa.array(terms, pa.binary()), pa.array([documents, *found.values()], pa.int64()), pa.array([words] + [0] * len(found), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "documents", "words"])

    counted = docs.select(text).mapInArrow(run, "term binary, documents long, words long")
    rows = counted.groupBy("term").agg(F.sum("documents"), F.sum("words")).collect()
    found = {bytes(term): n for term, n, _ in rows if term is not None}
    documents, words = next(((n, w) for term, n, w in rows if term is None), (0, 0))
    return found, documents, words


def best_documents(docs: DataFrame, items: dict, item_type: T.DataType, text: str, doc_id: str, top: int) -> DataFrame | None:
    """Each task's best documents for one block of items; None if no item can have any."""
    spark = docs.sparkSession
    found, documents, words = count_terms(docs, text, frozenset().union(*items.values()))
    search = Search(items, found, documents, words)
    if not search.items:
        return None
    shared = spark.sparkContext.broadcast(search)  # as long as the block of items, which is bounded
    arrow_type = pa.string() if isinstance(item_type, T.StringType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Search = shared.value
        best = Best(len(plan.items), top)
        for batch in batches:
            for part, texts in text_blocks(batch, text):
                ids = part[doc_id].cast(pa.int64())
                absent = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for k in range(0, len(texts), plan.columns):
                    span = slice(k, k + plan.columns)
                    best.add(plan.scores(texts[span]), ids[span], absent[span])
        best.shrink()
        item, score, absent, ids = best.rows
        names = [plan.items[i] for i in item.tolist()]
        columns = [pa.array(names, arrow_type), pa.array(ids, mask=absent.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    schema = T.StructType().add("item_id", item_type).add("doc_id", T.LongType()).add("score", T.LongType())
    return docs.select(doc_id, text).mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, text: str = "text", doc_id: str = "doc_id", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the highest score above 0.

    ``items`` has ``item_id`` (long or string) and ``text``. Rows with the same item_id, NULL included, are one item with the
    terms of all of them; repeated terms count once. Every row of ``docs`` is a document, so repeated rows rank one by
    one; equal scores go by ascending id (a whole number), NULL last, and are arbitrary only between rows of the same
    id. NULL and empty texts have no terms: such documents are not counted and never found, such items have no rows; the
    same holds for empty tables. Other columns are ignored, whatever their names. A long text is one column of a
    matrix, so its length costs only its own words.

    Items are taken in blocks of about ``block_items`` and 16 MB of text, each with two passes over the documents.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    item_type = asked.schema["item_id"].dataType
    if not isinstance(item_type, T.StringType):
        item_type = T.LongType()
        asked = asked.withColumn("item_id", F.col("item_id").cast(item_type))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // BLOCK_ITEM_BYTES))
    found = []
    for block in range(blocks):
        own: dict = defaultdict(set)
        # A block of items, bounded as said above (one longer than the bound makes a block of its own length).
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            own[row.item_id].update(terms_of(row.text.encode()))
        if own and (rows := best_documents(docs, dict(own), item_type, text, doc_id, top)) is not None:
            found.append(rows)
    if not found:
        empty = T.StructType().add("item_id", item_type).add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType())
        return spark.createDataFrame([], empty)
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    # Two steps, so that no task gets all tasks' rows of an item.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    rows = ranked([F.col("item_id"), salt], top, rows).drop("rank")
    return ranked([F.col("item_id")], top, rows).select("item_id", "rank", "doc_id", "score")
