"""Trie of conversation prefixes by ROLLUP over positional turn columns.

A conversation's turns are laid out in rows of ``WIDTH`` columns, one per position; longer ones continue in further
rows, each keyed by the node at which the row before it ended. One GROUP BY key, ROLLUP(columns) then makes the nodes
of all depths together, and the same ROLLUP over the nodes, with grouping_id, sums what lies below each of them.

A node is named by 128 bits: the XOR, over its positions, of a hash of position and turn. So the name of a prefix can
be put together from blocks in any grouping, and neither names nor sums need a step per block: blocks of ``WIDTH``
turns are themselves the columns of a second level, whose nodes are the prefixes at which rows end, and so on. Levels
grow with the logarithm of the longest conversation. No step gathers more than ``WIDTH`` rows of a conversation or a
node, so a conversation, a first turn or a group of copies with a third of all rows is spread over all tasks.

The digest of a node's members is one SHA-256 over all of them, which no one can compute but in order. Members are
put together in parts of ``PART`` ids first; the parts of a node pass through one task, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import stored, words
from grainguard.plans.sorted_chunks import exact_ranks
from grainguard.session import ship

WIDTH = 8
PART = 1000
SLOTS = range(1, WIDTH + 1)
COLUMNS = [f"c{i}" for i in SLOTS]
ROLLED = f"ka, kb, block, ROLLUP({', '.join(COLUMNS)})"
# Bits of grouping_id are set for the columns that are rolled up.
LEVEL = f"CAST({WIDTH} - bit_count(grouping_id()) AS INT)"


def xor(*values: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), values)


def lanes(which: str, upto: int = WIDTH) -> Column:
    """XOR of the row's turns up to a column; missing ones change nothing."""
    return xor(*(F.coalesce(F.col(f"c{i}.{which}"), F.lit(0)) for i in range(1, upto + 1)))


def at_level() -> Column:
    """The turn in the last column that is not rolled up; NULL where the conversation ends before it."""
    return F.get(F.array(*COLUMNS), F.col("level") - 1)


# ---------------------------------------------------------------- turns


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_words), pos from 1 on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(words(text)).cast("long").alias("n_words"),
    )
    return exact_ranks(turns, ["conv_id"], "turn", "digest", kinds=["row_number"]).select(
        "conv_id", F.col("row_number").alias("pos"), "digest", "n_words"
    )


def heads_shared(turns: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """(conv, len, pos, digest, n_words): conversation c begins with the first h turns of c - c % group, where h is the
    CRC-32 of c modulo ``most`` + 1, and goes on with its own turns after its first h; turnless ones have one row
    without a position."""
    convs = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    info = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    info = info.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    info = info.withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    info = stored(info.select("conv_id", "base", "h", "taken", "len"), "conversations")
    rest = turns.join(info, "conv_id").where("pos > h")
    rest = rest.select(F.col("conv_id").alias("conv"), "len", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_words")
    head = turns.where((F.col("pos") <= most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    head = head.join(info, "base").where("pos <= h").select(F.col("conv_id").alias("conv"), "len", "pos", "digest", "n_words")
    none = info.where("len = 0").selectExpr("conv_id AS conv", "len", "CAST(NULL AS BIGINT) AS pos", "CAST(NULL AS STRING) AS digest", "0L AS n_words")
    return rest.union(head).union(none)


# ---------------------------------------------------------------- rows of columns


def laid_out(rows: DataFrame) -> DataFrame:
    """(conv, block, len, c1, ...) of rows (conv, len, pos, a, b, n_words): up to ``WIDTH`` positions a row."""
    slot = F.pmod(F.col("pos") - 1, F.lit(WIDTH)) + 1
    placed = [F.max(F.when(slot == i, F.col(v))).alias(f"{v}{i}") for i in SLOTS for v in ("a", "b", "n_words")]
    wide = rows.groupBy("conv", F.floor((F.col("pos") - 1) / WIDTH).cast("long").alias("block")).agg(F.max("len").alias("len"), *placed)
    turns = [
        F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"n_words{i}").alias("n_words"))).alias(f"c{i}")
        for i in SLOTS
    ]
    return wide.select("conv", "block", "len", *turns)


def levels_of(turns: DataFrame) -> list[DataFrame]:
    """Rows of columns, level by level: (conv, block, len, c1, ..., ka, kb), keyed by the name of what lies before the row.

    ``turns`` has (conv, len, pos, a, b, n_words). A level's rows that another row of the conversation follows are the
    turns of the next level, whose nodes are thus the keys of this one.
    """
    wides = [stored(laid_out(turns), "rows")]
    after = F.floor((F.col("len") - 1) / WIDTH).cast("long")
    while True:
        more = wides[-1].where(F.col("block") < after)
        if more.isEmpty():
            break
        wides.append(stored(laid_out(more.select(
            "conv", after.alias("len"), (F.col("block") + 1).alias("pos"), lanes("a").alias("a"), lanes("b").alias("b"), F.lit(0).cast("long").alias("n_words")
        )), "rows"))
    zero = F.lit(0).cast("long")
    keyed = [wides[-1].withColumns({"ka": zero, "kb": zero})]
    for wide in reversed(wides[:-1]):
        names = F.array(*(
            F.when(F.col(f"c{i}").isNotNull(), F.struct(
                (F.col("block") * WIDTH + i).alias("block"), xor(F.col("ka"), lanes("a", i)).alias("ka"), xor(F.col("kb"), lanes("b", i)).alias("kb")
            )) for i in SLOTS
        ))
        before = keyed[0].select("conv", F.explode(names).alias("n")).where("n IS NOT NULL").select("conv", "n.*")
        rows = wide.join(before, ["conv", "block"], "left")
        keyed.insert(0, stored(rows.withColumns({"ka": F.coalesce("ka", zero), "kb": F.coalesce("kb", zero)}), "rows"))
    return keyed


# ---------------------------------------------------------------- nodes and sums


def nodes_of(wide: DataFrame) -> DataFrame:
    """One row per prefix: its name (na, nb), its parent's (pa, pb), its place and its members' count, least and longest."""
    rolled = wide.sparkSession.sql(
        f"SELECT ka, kb, block, {', '.join(COLUMNS)}, {LEVEL} AS level, min(conv) AS conv_id, count(*) AS n_convs, "
        f"max(len) AS longest FROM {{wide}} GROUP BY {ROLLED}",
        wide=wide,
    )
    last = at_level()
    named = rolled.where((F.col("level") > 0) & last.isNotNull()).withColumns(
        {"na": xor(F.col("ka"), lanes("a")), "nb": xor(F.col("kb"), lanes("b")), "n_words": last["n_words"]}
    )
    parents = {"pa": xor(F.col("na"), last["a"]), "pb": xor(F.col("nb"), last["b"]), "depth": F.col("block") * WIDTH + F.col("level")}
    return stored(named.withColumns(parents), "nodes")


def sums_below(nodes: DataFrame) -> DataFrame:
    """(na, nb, level, block, saved, leaves, children) of every node, and of what is before each row as level 0: sums over its row's subtree."""
    counts = ", ".join(f"count_if(level = {i}) AS k{i}" for i in SLOTS)
    rolled = nodes.sparkSession.sql(
        f"SELECT ka, kb, block, {', '.join(COLUMNS)}, {LEVEL} AS level, sum(saved) AS saved, sum(leaves) AS leaves, {counts} "
        f"FROM {{nodes}} GROUP BY {ROLLED}",
        nodes=nodes,
    )
    children = F.get(F.array(*(f"k{i}" for i in SLOTS)), F.col("level"))
    return rolled.where((F.col("level") == 0) | at_level().isNotNull()).select(
        xor(F.col("ka"), lanes("a")).alias("na"), xor(F.col("kb"), lanes("b")).alias("nb"), "level", "block", "saved", "leaves",
        F.coalesce(children, F.lit(0).cast("long")).alias("children"),
    )


def subtree_sums(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The nodes of the first level, and (na, nb, level, block, saved, leaves, children) of each with its whole subtree."""
    nodes = [nodes_of(wide) for wide in levels]
    leaf = (F.col("longest") == F.col("depth")).cast("long")
    valued = [nodes[0].withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_words"), "leaves": leaf})]
    for above in nodes[1:]:
        # What a row of this level holds is the value of the node that the row follows.
        held = valued[-1].where("block > 0").groupBy(F.col("ka").alias("na"), F.col("kb").alias("nb"))
        held = held.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.count_if(F.col("level") == 1).alias("next_children"))
        valued.append(stored(above.join(held, ["na", "nb"]), "nodes"))
    below = None
    for k in range(len(levels) - 1, -1, -1):
        own = valued[k]
        if below is not None:
            deeper = below.where("level > 0").selectExpr("na", "nb", "saved AS more_saved", "leaves AS more_leaves")
            own = own.join(deeper, ["na", "nb"], "left").withColumns(
                {"saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0))}
            )
        below = stored(sums_below(own), "sums")
    if len(levels) > 1:
        following = valued[1].select("na", "nb", "next_children")
        below = below.join(following, ["na", "nb"], "left").withColumn(
            "children", F.when(F.col("level") == WIDTH, F.coalesce("next_children", F.lit(0))).otherwise(F.col("children"))
        ).drop("next_children")
    return nodes[0], below


# ---------------------------------------------------------------- members that end at a node


def ends_digest(ends: DataFrame) -> DataFrame:
    """(na, nb, ends_sha256) of rows (na, nb, conv): SHA-256 over the decimal ids, ascending, joined by commas."""
    ship(ends.sparkSession)
    ranked = exact_ranks(ends, ["na", "nb"], "conv", "conv", kinds=["row_number"])
    part = F.floor((F.col("row_number") - 1) / PART).cast("long")
    parts = ranked.groupBy("na", "nb", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    parts = parts.repartition("na", "nb").sortWithinPartitions("na", "nb", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for na, nb, ids in zip(*(batch[c].to_pylist() for c in ("na", "nb", "ids")), strict=True):
                if (na, nb) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (na, nb), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield rows_of(done)
        if node is not None:
            yield rows_of([(*node, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        na, nb, digest = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(digest, pa.string())], ["na", "nb", "ends_sha256"])

    return parts.mapInArrow(run, "na long, nb long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (its least member), depth, parent_conv_id (its parent's, NULL for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    ``turns`` has (conv, len, pos, digest, n_words): all turns of all conversations, and a row with a NULL pos for each
    that has none. Members of a node are the conversations that begin with its turns; all are members of the root.
    No conversations, no nodes. Equal conversations are members and ends of the same nodes, each by itself.
    """
    named = turns.where("pos IS NOT NULL").select(
        "conv", "len", "pos", F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", "pos").alias("b"), "n_words"
    )
    levels = levels_of(named)
    nodes, sums = subtree_sums(levels)
    final = levels[0].where(F.col("block") == F.floor((F.col("len") - 1) / WIDTH))
    final = final.select(xor(F.col("ka"), lanes("a")).alias("na"), xor(F.col("kb"), lanes("b")).alias("nb"), "conv")
    turnless = turns.where("pos IS NULL").selectExpr("0L AS na", "0L AS nb", "conv")
    ends = stored(ends_digest(final.union(turnless)), "ends")

    convs = levels[0].where("block = 0").select("conv").union(turnless.select("conv"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L AS na", "0L AS nb", "CAST(NULL AS BIGINT) AS pa", "CAST(NULL AS BIGINT) AS pb", "0L AS depth", "conv_id", "n_convs")
    every = nodes.select("na", "nb", "pa", "pb", F.col("depth").cast("long").alias("depth"), "conv_id", "n_convs").union(root)
    every = stored(every, "nodes")
    own = sums.where("level > 0 OR block = 0").select("na", "nb", "saved", "leaves", "children")
    parents = every.selectExpr("na AS pa", "nb AS pb", "conv_id AS parent_conv_id")
    joined = every.join(own, ["na", "nb"], "left").join(parents, ["pa", "pb"], "left").join(ends, ["na", "nb"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("children", F.lit(0).cast("long")).alias("n_children"),
        # Only a root without children has no sums: it is childless itself.
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table (conv_id, turn, role, text); see ``heads_shared``.

    Turns go by ``turn``, NULL first, equal ones by the SHA-256 of role and text; repeated rows are turns of their own. A
    NULL role or text is empty. Rows without a conv_id belong to no conversation. Other columns are ignored, whatever
    their names. An empty table has no nodes. Long texts are reduced to a digest and a word count where they are read.
    """
    turns = stored(numbered_turns(conversations), "turns")
    return prefix_trie(stored(heads_shared(turns), "turns"))
