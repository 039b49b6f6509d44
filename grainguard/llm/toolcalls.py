"""Tool calls in conversations: linked with their results, ordered by dependency, validated, serialised.

Calls and results meet in a hash join by conversation and identifier; where an identifier repeats, the first call
and the first result count, found by minima with map-side combination, so a conversation that holds a third of
all rows is no group that any task must hold.

Order. Most calls depend on earlier turns, so turns order them already. What changes that are calls that wait for
a later one: ``ready_turn`` is the latest turn among all a call depends on, found by rounds over the links that
still raise it; ``level`` orders calls that are ready at one turn, by peeling off those with nothing left to wait
for. Rounds follow the longest chain of such late links, not the length of a conversation. Calls that are never
peeled off wait for a cycle. (ready_turn, level, turn, call_id) is then a topological order.

Arguments are parsed as variants, whose objects are sorted by key: written back, they are canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.llm.columns import stored

NODE = ["conv_id", "call_id"]
#: JSON types by how a variant's schema is written.
TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT<", "array": "^ARRAY<",
}


def quoted_json(text: Column) -> Column:
    """A string as JSON."""
    raw = F.to_json(F.array(text))
    return F.substring(raw, F.lit(2), F.length(raw) - 2)


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no blanks; NULL if it can't be parsed."""
    return F.to_json(F.try_parse_json(text))


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted array of what is wrong: ``unknown_tool``, ``malformed``, ``missing:f``, ``type:f``, ``unexpected:f``."""
    parsed = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            if required:
                found.append(F.when(value.isNull(), f"missing:{field}"))
            found.append(F.when(value.isNotNull() & ~value.rlike(TYPES[kind]), f"type:{field}"))
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), none), F.array(*map(F.lit, fields)))
        wrong = F.concat(F.array_compact(F.array(*found)), F.transform(extra, lambda k: F.concat(F.lit("unexpected:"), k)))
        out = F.when(name == tool, F.array_sort(wrong)).otherwise(out)
    broken = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit("malformed"))).otherwise(out)


def ready_turns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``ready_turn``: the latest turn of a call and all that it waits for."""
    now = stored(nodes.withColumn("ready_turn", F.col("turn")), "ready")
    while True:
        before = now.select("conv_id", F.col("call_id").alias("dep"), F.col("ready_turn").alias("later"))
        raised = edges.join(before, ["conv_id", "dep"]).join(now, NODE).where("later > ready_turn")
        raised = stored(raised.groupBy(*NODE).agg(F.max("later").alias("later")), "ready")
        if raised.isEmpty():
            return now
        now = stored(now.join(raised, NODE, "left").withColumn("ready_turn", F.coalesce("later", "ready_turn")).drop("later"), "ready")


def levels(ready: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that wait for others ready at the same turn; NULL if for a cycle."""
    turn = ready.select(*NODE, "ready_turn")
    dep = turn.withColumnsRenamed({"call_id": "dep", "ready_turn": "__t"})
    ties = edges.join(turn, NODE).join(dep, ["conv_id", "dep"]).where("ready_turn = __t").select(*NODE, "dep")
    ties = stored(ties, "ties")
    waiting = ties.select(*NODE).distinct()
    placed, open_ties, level = None, ties, 0
    while not open_ties.isEmpty():
        level += 1
        waits = open_ties.select(*NODE).distinct()
        blocked = open_ties.join(waits.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi").select(*NODE)
        free = stored(waits.join(blocked.distinct(), NODE, "left_anti").withColumn("level", F.lit(level)), "levels")
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        open_ties = stored(open_ties.join(free, NODE, "left_anti"), "ties")
    if placed is None:
        return waiting.withColumn("level", F.lit(None).cast("int"))
    return waiting.join(placed, NODE, "left")


def link_tool_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], unlinked: bool = False
) -> DataFrame:
    """One row per identifier that is called or answered in a conversation.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of identifiers). ``results``:
    conv_id, call_id, turn, content. ``schemas``: tool -> field -> (type, required). Other columns are not read.
    Returns conv_id, call_id, turn, name, status, errors, n_calls, n_results, ready_turn, level and ``message``,
    the canonical JSON of call and result. ``status`` is the first that holds of: orphan_result (no call),
    invalid (errors in name or arguments), missing_dependency, cycle (waits for itself), unanswered, linked.

    Of calls or results that share an identifier the first by turn counts (ties: by their text); the others only
    add to n_calls and n_results. Rows with a NULL conversation or identifier can't be linked and are left out or,
    if ``unlinked``, stay as rows of their own: calls that have an identifier as invalid or unanswered, others as
    orphan_result with a NULL message. NULL arguments are malformed, a NULL turn is before all others, NULL dependencies are none and a repeated
    dependency counts once. Empty tables give what the other one has.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    own = F.struct(turn.alias("turn"), "name", "arguments", F.array_sort(F.array_distinct(F.array_compact("depends_on"))).alias("depends_on"))
    first = calls.where(known).groupBy(*NODE).agg(F.min(own).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    answer = F.struct(turn.alias("turn"), "content")
    answered = results.where(known).groupBy(*NODE).agg(F.min(answer).alias("r"), F.count(F.lit(1)).alias("n_results"))
    first = stored(first.select(*NODE, "c.*", "n_calls"), "calls")

    nodes = first.select(*NODE, "turn")
    wanted = first.select(*NODE, F.explode("depends_on").alias("dep"))
    edges = stored(wanted.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi"), "edges")
    lost = wanted.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
    ready = ready_turns(nodes, edges)
    level = levels(ready, edges).withColumn("waits", F.lit(True))
    linked = (
        first.join(answered, NODE, "full")
        .join(ready.select(*NODE, "ready_turn"), NODE, "left")
        .join(level, NODE, "left")
        .join(lost.select(*NODE).distinct().withColumn("lost", F.lit(True)), NODE, "left")
    )
    linked = linked.withColumn("called", F.col("n_calls").isNotNull())
    if unlinked:
        one = F.when(F.col("call_id").isNotNull(), F.lit(1).cast("long"))
        lone = calls.where(f"NOT ({known})").select(*NODE, own.alias("c"), "turn", one.alias("n_calls"), F.lit(True).alias("called"))
        lone = lone.select(*NODE, F.col("turn").cast("long").alias("turn"), "c.name", "c.arguments", "c.depends_on", "n_calls", "called")
        plain = F.struct(F.col("turn").cast("long").alias("turn"), "content")
        lost_results = results.where(f"NOT ({known})").select(*NODE, plain.alias("r"), one.alias("n_results"), F.lit(False).alias("called"))
        for more in (lone, lost_results):
            linked = linked.unionByName(more, allowMissingColumns=True)
    wrong = errors(F.col("name"), F.col("arguments"), schemas)
    linked = linked.withColumn("errors", F.when(F.col("called"), wrong).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("lost"), "missing_dependency")
        .when(F.col("waits") & F.col("level").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
    )
    null = F.lit("null")
    fields = [
        ("arguments", F.coalesce(canonical(F.col("arguments")), null)),
        ("call_id", quoted_json(F.col("call_id"))),
        ("depends_on", F.coalesce(F.to_json("depends_on"), F.lit("[]"))),
        ("name", F.coalesce(F.when(F.col("name").isNotNull(), quoted_json(F.col("name"))), null)),
        ("result", F.coalesce(F.when(F.col("r.content").isNotNull(), quoted_json(F.col("r.content"))), null)),
    ]
    message = F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(fields) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)), F.lit("}"))
    zero = F.lit(0).cast("long")
    return linked.select(
        "conv_id", "call_id", F.coalesce("turn", "r.turn").alias("turn"), "name", status.alias("status"),
        F.array_join("errors", ",").alias("errors"),
        F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_results", zero).alias("n_results"),
        F.coalesce("ready_turn", "r.turn").alias("ready_turn"),
        F.when(F.col("waits").isNull(), 0).otherwise(F.col("level")).alias("level"),
        F.when(F.col("call_id").isNotNull(), message).alias("message"),
    )


#: The tools of the messages that ``messages_of`` derives.
SCHEMAS = {
    "search": {"text": ("string", True), "limit": ("integer", True), "exact": ("boolean", False)},
    "lookup": {"text": ("string", True), "limit": ("integer", False)},
}


def messages_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from chat turns: a user's turn calls, the assistant's next turn answers.

    What the arguments are, whether they are valid, and what a call waits for follow from the text's length.
    """
    n, at = F.length(F.coalesce("text", F.lit(""))), F.col("turn")
    user = conversations.where("role = 'user'")
    name = F.when(n % 4 == 0, "lookup").when(n % 4 == 3, "convert").otherwise("search")
    whole = F.to_json(F.struct("text", n.alias("limit"), (n % 2 == 0).alias("exact")))
    arguments = (
        F.when(n % 11 == 0, F.lit('{"text": '))
        .when(n % 7 == 0, F.to_json(F.struct("text", n.cast("string").alias("limit"))))
        .when(n % 13 == 0, F.to_json(F.struct(n.alias("limit"))))
        .when(n % 4 == 0, F.to_json(F.struct("text", n.alias("limit"))))
        .otherwise(whole)
    )
    name_of = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    waits = F.array(F.when(n % 2 == 0, name_of(at - 2)), F.when(n % 5 == 0, name_of(at + 2)))
    calls = user.select("conv_id", name_of(at).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.array_compact(waits).alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", name_of(at - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
