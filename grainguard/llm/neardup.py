"""Near-duplicate groups by an inverted join of MinHash coordinates, verified on full shingle sets.

1. One scan makes each text's set of distinct five-word shingles, its digest and a signature of ``COORDINATES``
   minima. Texts of equal sets become one class; only classes go on, so copies are never paired.
2. A class is posted under (coordinate, value) pairs. Two sets of the wanted similarity agree in at least
   ``MATCHES`` coordinates (all but about four in a million such pairs do), hence share a pair among the
   ``COORDINATES - MATCHES + 1`` rarest of each: this prefix alone is posted (*prefix merging*), and the most
   frequent pairs, the long lists, are never merged but only looked at in the candidates (*skip merging*).
   Rarity is one fixed order for all, from a table of counts of fixed size.
3. Lists are not paired out. First every list links its members to its hub, the member whose values are most
   frequent (of copies with changes that is the text they come from). Candidates of short lists that agree in
   ``MATCHES`` coordinates, and all members of long lists, are compared with the hub on the full sets, and the links
   joined to components. Then only pairs from one list that lie in different components are left. In short lists
   their collisions are counted, and those above the threshold verified. In long ones the members' shingles outside
   the hub decide (``beyond_hubs``): sets that miss the hub share some of these, or reach the similarity by the
   hub's own shingles alone. After that no pair that shares a posting is undecided, so no link between different
   texts is lost, and no group is paired out.

Lists and hubs with many members are split by salt. A set is made from its text where it is compared: it travels once
to each block of a hub's partners, and is never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainguard.llm.columns import SHINGLE, SIMILAR_PERCENT, stored
from grainguard.llm.components import components
from grainguard.llm.hashing import U64, mix, numbers, text_blocks, window_hashes, word_hashes
from grainguard.session import ship

COORDINATES = 48
MATCHES = 22
PREFIX = COORDINATES - MATCHES + 1
BUCKETS = 1 << 20
#: A value seen this often in a batch is worth a place in the table of counts.
SEEN = 3
#: Members of a list up to which its open pairs are counted one by one: at most this many for each member.
SHORT = 64
#: Members of a list, or partners of a hub, that one task compares.
BLOCK = 4096
#: Bits of a summary of the hub's shingles that a member has.
BRIEF = 512
#: Bits of a summary of a member's shingles outside the hub.
FRINGE = 1024
#: Numbers of compared pairs that a task holds before it puts them out.
HELD = 1 << 22
FACTORS, FLIPS = numbers(11, COORDINATES), numbers(12, COORDINATES)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(window_hashes(word_hashes(text.lower()), SHINGLE, 1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat ^ FLIPS[k]) * FACTORS[k]) >> U64(32), starts)
    return out


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, content, n_shingles, digest, signature) of each row; the last two are NULL for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                sets = [shingle_set(t) for t in texts]
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["content"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "content", "n_shingles", "digest", "signature"],
                )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, content long, n_shingles long, digest binary, signature binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def postings_of(signed: np.ndarray) -> np.ndarray:
    """Name of each (coordinate, value) pair."""
    return mix((np.arange(COORDINATES, dtype=U64)[None, :] << U64(32)) | signed.astype(U64))


def frequencies(classes: DataFrame) -> np.ndarray:
    """How often frequent pairs occur, in ``BUCKETS`` buckets by name: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, seen = np.unique(postings_of(matrix(batch["signature"])), return_counts=True)
            names, seen = names[seen >= SEEN], seen[seen >= SEEN]
            yield pa.RecordBatch.from_arrays([pa.array((names % U64(BUCKETS)).astype(np.int64)), pa.array(seen)], ["b", "n"])

    table = np.zeros(BUCKETS, np.int64)
    counted = classes.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    for part in counted.toArrow().to_batches():  # at most BUCKETS rows
        table[part["b"].to_numpy()] = part["n"].to_numpy()
    return table


def prefixes(classes: DataFrame, table: np.ndarray) -> DataFrame:
    """(name, central, node): each class under its rarest pairs; ``central`` is how frequent its values are."""
    shared = classes.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = postings_of(matrix(batch["signature"]))
            often = shared.value[(names % U64(BUCKETS)).astype(np.int64)]
            rare = np.lexsort((names, often))[:, :PREFIX]
            chosen = np.take_along_axis(names, rare, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chosen.ravel()),
                    pa.array(np.repeat(often.sum(1), PREFIX)),
                    pa.array(np.repeat(batch["node"].to_numpy(), PREFIX)),
                ],
                ["name", "central", "node"],
            )

    return classes.select("node", "signature").mapInArrow(run, "name long, central long, node long")


def shared_lists(posted: DataFrame) -> DataFrame:
    """(name, node, hub, n): the postings of lists with two members or more, with the list's hub and length."""
    rank = F.col("central") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    # Map-side maxima: a list in which a third of all rows meet is a row per task.
    lists = posted.groupBy("name").agg(F.max_by("node", rank).alias("hub"), F.count("node").alias("n"))
    return posted.select("name", "node").join(lists.where("n > 1").select("name", "hub", "n"), "name")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(hub, other, long): every member of a list with the list's hub, once; ``long`` if one such list is."""
    pairs = lists.where("node <> hub").groupBy("hub", F.col("node").alias("other"))
    return pairs.agg((F.max("n") > SHORT).alias("long"))


def above_threshold(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of near enough sizes whose signatures agree in at least ``MATCHES`` coordinates."""
    signed = classes.select("node", "n_shingles", "signature")
    both = pairs.join(signed.withColumnsRenamed({"node": "a", "n_shingles": "na", "signature": "sa"}), "a")
    both = both.join(signed.withColumnsRenamed({"node": "b", "n_shingles": "nb", "signature": "sb"}), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (matrix(batch["sa"]) == matrix(batch["sb"])).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(agree >= MATCHES))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def at_hubs(pairs: DataFrame) -> DataFrame:
    """(hub, parts, salt, long, role, other): each block of a hub's partners with the hub's own row (role 0).

    ``parts`` is 0 where all of a hub's partners are one block.
    """
    sized = pairs.join(pairs.groupBy("hub").agg(F.floor(F.count("other") / BLOCK).alias("parts")), "hub")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("parts") + 1))
    centres = salted.select("hub", "parts", "salt").distinct()
    centres = centres.select("hub", "parts", "salt", F.lit(False).alias("long"), F.lit(0).alias("role"), F.col("hub").alias("other"))
    return centres.unionByName(salted.select("hub", "parts", "salt", "long", F.lit(1).alias("role"), "other"))


def with_sets(places: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``places`` (from ``at_hubs``) with the full shingle set of ``other``, the rows of a block in one task, hub first."""
    names = places.columns
    named = classes.select(F.col("node").alias("other"), "doc_id", "digest")
    wanted = stored(places.join(named, "other"), "places")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The list grows with the documents, so it is never broadcast: one plan at every size.
    own = own.join(wanted.hint("merge"), "doc_id").select(*names, "digest", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own, digest = None, b"", b""
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                found, same = [], []
                for t, d in zip(texts, part["digest"].to_pylist(), strict=True):
                    if t != before:  # the places of one text follow each other
                        before, own = t, shingle_set(t).tobytes()
                        digest = xxhash.xxh3_128_digest(own)
                    found.append(own)
                    same.append(digest == d)
                columns = [*(part[c] for c in names), pa.array(found, pa.binary())]
                out = pa.RecordBatch.from_arrays(columns, [*names, "set"])
                yield out.filter(pa.array(same, pa.bool_()))

    made = own.mapInArrow(sets, "hub long, parts long, salt long, long boolean, role int, other long, set binary")
    return made.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "other")


def folded(outer: np.ndarray | None) -> tuple[np.ndarray | None, int | None]:
    """(bits, spare): shingles as ``FRINGE`` bits, and how many of them fall on a bit that another one has set."""
    if outer is None:
        return None, None
    has = np.zeros(FRINGE, bool)
    has[(outer & U64(FRINGE - 1)).astype(np.int64)] = True
    return np.packbits(has).view(np.int64), len(outer) - int(has.sum())


def compared(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int
) -> DataFrame:
    """(hub, parts, long, other, n, o, h, linked, outer, bits, brief, fringe, spare) of each pair (hub, other, long), from the full sets.

    ``n`` and ``h`` are the sizes of both sets, ``o`` the shingles in both, ``linked`` whether these are enough. For
    long pairs ``bits`` says which of the hub's shingles the partner has, and ``outer`` holds its other ones; where all
    long partners of a hub stand side by side, those that no other has are left out. ``brief`` is ``bits`` folded to ``BRIEF``,
    ``fringe`` is ``outer`` by the last bits of its hashes, and ``spare`` how many of ``outer`` share a bit with one before them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, mine, block, held, parted = None, None, np.empty(0, U64), [], 0, False

        def rows(whole: bool) -> pa.RecordBatch:
            outer = [x[7] for x in block]
            if whole and any(x is not None for x in outer):
                values, seen = np.unique(np.concatenate([x for x in outer if x is not None]), return_counts=True)
                values = values[seen > 1]
                outer = [None if x is None else np.intersect1d(x, values, assume_unique=True) for x in outer]
            fringe, spare = zip(*map(folded, outer), strict=True)
            longs, lists = pa.int64(), pa.list_(pa.int64())
            types = [longs, longs, pa.bool_(), longs, longs, longs, longs]
            columns = [pa.array([x[k] for x in block], t) for k, t in enumerate(types)]
            columns.append(pa.array([100 * x[5] >= percent * (x[4] + x[6] - x[5]) for x in block], pa.bool_()))
            columns.append(pa.array([None if x is None else x.view(np.int64) for x in outer], lists))
            columns += [pa.array([x[k] for x in block], lists) for k in (8, 9)]
            columns += [pa.array(fringe, lists), pa.array(spare, longs)]
            names = ["hub", "parts", "long", "other", "n", "o", "h", "linked", "outer", "bits", "brief", "fringe", "spare"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("hub", "parts", "salt", "long", "role", "other")]
            for k, (hub, parts, salt, long, role, other) in enumerate(zip(*columns, strict=True)):
                if (hub, salt, role, other) == last:
                    continue  # a row that is there twice
                last = (hub, salt, role, other)
                if at != (hub, salt) or held > HELD:
                    if block:
                        ends = at != (hub, salt)
                        yield rows(ends and not parted and block[0][1] == 0)
                        parted = not ends
                    else:
                        parted = False
                    block, held = [], 0
                own = np.frombuffer(batch["set"][k].as_buffer(), U64)
                if role == 0:
                    at, mine = (hub, salt), own
                elif at == (hub, salt):
                    place = np.searchsorted(mine, own)
                    inside = mine[np.minimum(place, len(mine) - 1)] == own
                    outer = bits = brief = None
                    if long:
                        has = np.zeros(-(-len(mine) // BRIEF) * BRIEF, bool)
                        has[place[inside]] = True
                        outer, bits = own[~inside], np.packbits(has).view(np.int64)
                        brief = np.packbits(has.reshape(-1, BRIEF).any(0)).view(np.int64)
                    block.append((hub, parts, long, other, len(own), int(inside.sum()), len(mine), outer, bits, brief))
                    held += 16 + (len(outer) + len(bits) if long else 0)
        if block:
            yield rows(not parted and block[0][1] == 0)

    sets = with_sets(at_hubs(pairs), classes, docs, key, text)
    return sets.mapInArrow(
        compare,
        "hub long, parts long, long boolean, other long, n long, o long, h long, linked boolean, outer array<long>, bits array<long>, brief array<long>, "
        "fringe array<long>, spare long",
    )


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(u, v): the pairs (a, b) whose full sets are similar enough."""
    # The end with more partners is the hub of its pairs.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    sized = pairs.join(ends.select(F.col("node").alias("a"), F.col("count").alias("na")), "a").join(
        ends.select(F.col("node").alias("b"), F.col("count").alias("nb")), "b"
    )
    first = F.col("na") >= F.col("nb")
    hub, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    oriented = sized.select(hub.alias("hub"), other.alias("other"), F.lit(False).alias("long"))
    return compared(oriented, classes, docs, key, text, percent).where("linked").select(F.col("hub").alias("u"), F.col("other").alias("v"))


def beyond_hubs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that long open lists leave; ``members`` are the long rows of ``compared``.

    Let *o* be what a member shares with its hub. Two members share at most the smaller *o* inside the hub, so a
    pair whose sizes ask for more must share shingles outside it, as many as are wanting. A member that is not
    linked with the hub (a *straggler*) therefore probes the members with its outer shingles, all but as many as
    are wanting less one, the rarest first, and keeps those with which it can share enough: inside no more than the folded
    bits of both allow, outside no more than the smaller number, or than the bits of both fringes and the shingles that
    set none. A pair that shares none outside is similar if what it shares inside is
    enough by itself: the bits of both count that, and only such pairs leave the join by blocks of a hub.
    """
    named = members.select("hub", "parts", "other", "n", "o", "h").join(labels.withColumnRenamed("node", "other"), "other", "left")
    named = named.join(labels.select(F.col("node").alias("hub"), F.col("component").alias("core")), "hub", "left")
    misses = F.coalesce("component", "other") != F.coalesce("core", "hub")
    named = stored(named.withColumns({"component": F.coalesce("component", "other"), "straggles": misses}).drop("core"), "named")
    # Only hubs that a member misses: elsewhere all is one component.
    hubs = named.groupBy("hub").agg(F.min("n").alias("least"), F.max("straggles").alias("open")).where("open").drop("open")
    both = 100 + percent
    wanting = F.ceil(F.lit(percent) * (F.col("n") + F.col("least")) / both) - F.col("o")
    opened = named.join(hubs, "hub").withColumn("wanting", wanting)
    parted = stored(opened.join(members.select("hub", "other", "outer", "bits", "brief", "fringe", "spare"), ["hub", "other"]), "parted")
    stragglers = parted.where("straggles")

    # All but as many as are wanting less one: those that were not sent, the rarest, are among them.
    outer = parted.select(
        "hub", F.col("other").alias("y"), F.col("component").alias("cy"), "n", "o", "h", F.col("brief").alias("by"),
        F.col("fringe").alias("fy"), F.col("spare").alias("sy"), F.explode("outer").alias("s")
    )
    often = outer.groupBy("hub", "s").agg(F.count("y").alias("often"))
    probes = stragglers.select(
        "hub", F.col("other").alias("x"), F.col("component").alias("cx"), F.explode("outer").alias("s"),
        (F.size("outer") - F.greatest("wanting", F.lit(1)) + 1).alias("some"),
        F.col("n").alias("nx"), F.col("o").alias("ox"), F.col("brief").alias("bx"),
        F.col("fringe").alias("fx"), F.col("spare").alias("sx"),
    ).join(often, ["hub", "s"])
    rank = F.row_number().over(Window.partitionBy("hub", "x").orderBy("often", "s"))
    probes = probes.withColumn("rank", rank).where("rank <= some AND often > 1").drop("some", "often", "rank")

    def common(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda sum_, n: sum_ + n)

    needed = (F.col("nx") + F.col("n")) * percent
    # A folded bit stands for at most so many of the hub's shingles; it is exact in hubs of up to ``BRIEF``.
    most = F.least(F.col("ox"), F.col("o"), common("bx", "by") * F.ceil(F.col("h") / BRIEF))
    # Shared shingles set shared bits, but for those that either side counts as spare.
    beside = F.least(F.col("nx") - F.col("ox"), F.col("n") - F.col("o"), common("fx", "fy") + F.least("sx", "sy"))
    met = probes.join(outer, ["hub", "s"]).where((F.col("cx") != F.col("cy")) & ((most + beside) * both >= needed)).select("x", "y")
    inner = stragglers.where("wanting <= 0").select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("salt"),
        F.col("other").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("o").alias("ox"), F.col("bits").alias("bx"),
    )
    others = parted.select(
        "hub", F.pmod(F.xxhash64("other"), F.col("parts") + 1).alias("salt"),
        F.col("other").alias("y"), F.col("component").alias("cy"), "n", "o", "bits",
    )
    inside = common("bx", "bits")
    near = inner.join(others, ["hub", "salt"])
    near = near.where((F.col("cx") != F.col("cy")) & (F.least("ox", "o") * both >= needed) & (inside * both >= needed))
    pairs = met.union(near.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, node, hub, component, n): the lists whose members lie in different components."""
    named = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = named.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("node").alias("n"))
    return named.join(spread.where("low < high").select("name", "n"), "name")


def remaining_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one list in different components, of near enough sizes, whose collisions reach the threshold."""
    own = lists.withColumn("parts", F.floor(F.col("n") / BLOCK).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts") + 1).cast("int"))
    blocks = own.select("name", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("other"))
    blocks = blocks.select("name", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    signed = blocks.join(classes.select("node", "n_shingles", "signature"), "node")

    def pairs_in(rows: list[tuple], signed: np.ndarray) -> np.ndarray:
        own, node, component, size = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 3))
        inner = len(set(own.tolist())) == 1
        found = []
        for k in range(len(node) - 1):
            later = np.arange(k + 1, len(node))
            later = later[(component[later] != component[k]) & (inner | (own[later] != own[k]))]
            later = later[100 * np.minimum(size[later], size[k]) >= percent * np.maximum(size[later], size[k])]
            later = later[(signed[later] == signed[k]).sum(1) >= MATCHES]
            found.append(np.stack([np.minimum(node[later], node[k]), np.maximum(node[later], node[k])]))
        return np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, parts = None, [], []

        def block() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                a, b = pairs_in(rows, np.stack(parts))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch["signature"])
            columns = [batch[c].to_pylist() for c in ("name", "i", "j", "own", "node", "component", "n_shingles")]
            for k, (name, i, j, own, node, component, size) in enumerate(zip(*columns, strict=True)):
                if (name, i, j) != at:
                    yield from block()
                    at, rows, parts = (name, i, j), [], []
                rows.append((own, node, component, size))
                parts.append(values[k])
        yield from block()

    ordered = signed.select("name", "i", "j", "own", "node", "component", "n_shingles", "signature").repartition("name", "i", "j")
    return ordered.sortWithinPartitions("name", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """(doc_id, content, n_shingles, component_id, kept) of every row; ``content`` is a hash of the text.

    Two texts are linked if the shared shingles are at least ``percent`` percent of all of both. A text of fewer
    than five words is one shingle; NULL and blank texts have none and are linked with nothing. Rows with equal
    sets are one class whatever their keys; rows with equal keys but other texts are not linked by their key.
    ``component_id`` is the least key that is reachable; ``kept`` says that the row has it. A row with a NULL key
    belongs to the class of its set, links nothing itself, and is kept with a NULL component if it is alone.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(sketched(docs, key, text), "sketches")
    keyed = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = keyed.groupBy("digest").agg(F.min("doc_id").alias("least"))
    own = keyed.join(least, "digest").where("doc_id = least").dropDuplicates(["digest"]).drop("content", "least")
    # A class is named by its least key, or by its digest where texts share a key.
    shared = stored(own.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared")), "shared")
    named = own.join(shared, F.col("doc_id") == F.col("shared"), "left")
    spare = -1 - F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1))
    node = F.when(F.col("shared").isNull(), F.col("doc_id")).otherwise(spare)
    classes = stored(named.select(node.alias("node"), "doc_id", "digest", "n_shingles", "signature"), "classes")

    lists = stored(shared_lists(stored(prefixes(classes, frequencies(classes)), "postings")), "lists")
    pairs = stored(hub_pairs(lists), "pairs")
    near = above_threshold(pairs.where("NOT long").select(F.col("hub").alias("a"), F.col("other").alias("b")), classes, percent)
    near = near.select(F.col("a").alias("hub"), F.col("b").alias("other"), F.lit(False).alias("long"))
    near = stored(near.unionByName(pairs.where("long")), "pairs")
    members = stored(compared(near, classes, docs, key, text, percent), "members")
    links = stored(members.where("linked").select(F.col("hub").alias("u"), F.col("other").alias("v")), "links")
    labels = stored(components(links), "labels")
    left = open_lists(lists.where(F.col("n") <= SHORT).drop("n"), labels)
    short = remaining_pairs(left, classes, percent)
    long = above_threshold(stored(beyond_hubs(members.where("long"), labels, percent), "pairs"), classes, percent)
    rest = stored(short.union(long).distinct(), "pairs")
    links = links.unionByName(verified(rest, classes, docs, key, text, percent))
    labels = stored(components(links), "labels")

    grouped = classes.select("digest", "doc_id", "node").join(labels, "node", "left").select(
        "digest", "doc_id", F.coalesce("component", "node").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = grouped.join(least, "component").select("digest", "component_id")
    out = rows.join(groups, "digest", "left").select(
        "doc_id", "content", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the least key of each group; columns are unchanged.

    Rows of a group that have the least key in common all stay, as do texts without words.
    """
    gone = near_duplicates(docs, key, text).where("NOT kept")
    gone = stored(gone.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct(), "copies")
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__content"))
    return docs.join(gone.hint("merge"), same, "left_anti")  # grows with the documents: never broadcast
