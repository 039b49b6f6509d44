"""The operators of this subpackage bound to the given tables, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainguard.llm import bpe, decontam, lexical, neardup, outliers, pii, prefixtrie, repeats, sharding, tokencoder, toolcalls, transducer, urls
from grainguard.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digests(sharding.shard_by_bytes(docs, 40, stored=True))


ORACLE["op1_histogram_sort"] = """
WITH table_ AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents
), placed AS (
  SELECT doc_id, size, bytes, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total FROM sized
), sharded AS (SELECT *, CAST(before * 40 // total AS INT) AS shard FROM placed
)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)
    AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM sharded, table_
"""


@query
def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digests(repeats.remove_repeats(docs))


ORACLE["op2_recompression"] = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), windows AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM places
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), repeats AS (
  SELECT doc_id, p FROM windows WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM repeats
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op3_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("content")


ORACLE["op3_coordinate_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: w[i + 1 : i + 5])) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT x, y FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id
"""


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.ranks_in(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


@query
def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *outliers.COUNTS, "base_failed", "kept")


@query
def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.fit(docs)))


# The rules that the contract states.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op7_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.messages_of(table(spark, sf_dir, "conversations"))
    return toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS, unlinked=True)


ORACLE["op8_tool_call_linking"] = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations
), calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, text, n,
    CASE WHEN n % 4 = 0 THEN 'lookup' WHEN n % 4 = 3 THEN 'convert' ELSE 'search' END AS name,
    list_sort(list_filter([CASE WHEN n % 2 = 0 THEN 'call_' || (turn - 2) END,
      CASE WHEN n % 5 = 0 THEN 'call_' || (turn + 2) END], lambda x: x IS NOT NULL)) AS depends_on
  FROM turns WHERE role = 'user'
), judged AS (
  SELECT *,
    CASE WHEN n % 11 = 0 THEN 'malformed' WHEN name = 'convert' THEN 'unknown_tool'
         WHEN n % 7 = 0 THEN 'type:limit' WHEN n % 13 = 0 THEN 'missing:text' ELSE '' END AS errors,
    CASE WHEN n % 11 = 0 THEN 'null'
         WHEN n % 7 = 0 THEN '{"limit":"' || n || '","text":' || to_json(text) || '}'
         WHEN n % 13 = 0 THEN '{"limit":' || n || '}'
         WHEN n % 4 = 0 THEN '{"limit":' || n || ',"text":' || to_json(text) || '}'
         ELSE '{"exact":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"limit":' || n
           || ',"text":' || to_json(text) || '}' END AS arguments
  FROM calls
), results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn, text FROM turns WHERE role = 'assistant'
), wanted AS (SELECT conv_id, call_id, unnest(depends_on) AS dep FROM calls
), edges AS (SELECT w.* FROM wanted w SEMI JOIN calls c ON c.conv_id = w.conv_id AND c.call_id = w.dep
), reach AS (
  SELECT conv_id, call_id, dep FROM edges
  UNION SELECT r.conv_id, r.call_id, e.dep FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.call_id = r.dep
), ready AS (
  SELECT c.conv_id, c.call_id, greatest(c.turn, coalesce(max(d.turn), c.turn)) AS ready_turn
  FROM calls c LEFT JOIN reach r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN calls d ON d.conv_id = r.conv_id AND d.call_id = r.dep GROUP BY c.conv_id, c.call_id, c.turn
), ties AS (
  SELECT e.* FROM edges e JOIN ready a ON a.conv_id = e.conv_id AND a.call_id = e.call_id
  JOIN ready b ON b.conv_id = e.conv_id AND b.call_id = e.dep WHERE a.ready_turn = b.ready_turn
), tied AS (
  SELECT * FROM ties
  UNION SELECT r.conv_id, r.call_id, e.dep FROM tied r JOIN ties e ON e.conv_id = r.conv_id AND e.call_id = r.dep
), stuck AS (
  SELECT DISTINCT a.conv_id, a.call_id FROM tied a
  JOIN tied b ON a.conv_id = b.conv_id AND (a.dep = b.call_id OR a.call_id = b.call_id) AND b.call_id = b.dep
), depths AS (
  SELECT conv_id, call_id, dep, 1 AS depth FROM ties ANTI JOIN stuck USING (conv_id, call_id)
  UNION SELECT r.conv_id, r.call_id, e.dep, r.depth + 1
  FROM depths r JOIN ties e ON e.conv_id = r.conv_id AND e.call_id = r.dep
), levels AS (SELECT conv_id, call_id, max(depth) AS level FROM depths GROUP BY ALL
), lost AS (SELECT DISTINCT w.conv_id, w.call_id FROM wanted w ANTI JOIN calls c ON c.conv_id = w.conv_id AND c.call_id = w.dep
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
  coalesce(c.turn, r.turn) AS turn, c.name,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN c.errors <> '' THEN 'invalid'
    WHEN l.call_id IS NOT NULL THEN 'missing_dependency' WHEN s.call_id IS NOT NULL THEN 'cycle'
    WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(c.errors, '') AS errors, CAST(c.call_id IS NOT NULL AS BIGINT) AS n_calls,
  CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results, coalesce(y.ready_turn, r.turn) AS ready_turn,
  CASE WHEN s.call_id IS NULL THEN coalesce(v.level, 0) END AS level,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"call_id":"' || coalesce(c.call_id, r.call_id)
    || '","depends_on":' || coalesce(CAST(to_json(c.depends_on) AS VARCHAR), '[]') || ',"name":'
    || coalesce('"' || c.name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null')
    || '}' AS message
FROM judged c FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
LEFT JOIN ready y ON y.conv_id = c.conv_id AND y.call_id = c.call_id
LEFT JOIN stuck s ON s.conv_id = c.conv_id AND s.call_id = c.call_id
LEFT JOIN levels v ON v.conv_id = c.conv_id AND v.call_id = c.call_id
LEFT JOIN lost l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
"""


@query
def op9_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.contained_items(docs, items)


ORACLE["op9_containment_search"] = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: w[i + 1 : i + 5])) AS s
  FROM split WHERE len(w) > 0
), items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS q FROM shingles WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, max(i.q) AS item_shingles, count(*) AS shared_shingles
FROM shingles d JOIN items i ON d.s = i.s WHERE d.kind = 'd'
GROUP BY d.id, i.id HAVING count(*) * 100 >= max(i.q) * 75
"""


@query
def op10_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    folder = new_folder(spark, "token-ids")
    tokencoder.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, folder)
    return tokencoder.digests(spark.read.parquet(folder))


@query
def op11_streaming_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return transducer.digests(transducer.encode(docs, tokenizer, decoded="decoded"))


@query
def op12_rollup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE["op12_rollup_trie"] = """
WITH table_ AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS p,
    {'role': role, 'text': text} AS said FROM plain
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295,
    list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), table_
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, p, said FROM convs c JOIN turns t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, said FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND p > h
), paths AS (
  SELECT c.conv_id, coalesce(path, []) AS path, len(coalesce(path, [])) AS n
  FROM convs c LEFT JOIN (SELECT conv_id, list(said ORDER BY part, p) AS path FROM rebuilt GROUP BY conv_id) r USING (conv_id)
), nodes AS (
  SELECT path[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM (SELECT conv_id, path, n, unnest(range(n + 1)) AS d FROM paths) GROUP BY ALL
), children AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1)
    * len(regexp_extract_all(n.k[-1]['text'], '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children c ON c.k = n.k
), below AS (
  SELECT k[1:a] AS k, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT k, saved, n_children, unnest(range(d + 1)) AS a FROM counted) GROUP BY 1
)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.k = c.k LEFT JOIN nodes p ON c.d > 0 AND p.k = c.k[1:c.d - 1]
"""


@query
def op13_shared_subexpressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_shared_subexpressions"] = """
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), terms AS (
  SELECT kind, id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM folded
), counts AS (SELECT id, t, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY id, t
), lengths AS (SELECT id, count(*) AS n FROM terms WHERE kind = 'd' GROUP BY id
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY t
), scored AS (
  SELECT i.id AS item_id, c.id AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words))))) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, t FROM terms WHERE kind = 'i') i JOIN counts c ON c.t = i.t JOIN weights g ON g.t = i.t
  JOIN lengths l ON l.id = c.id, totals GROUP BY i.id, c.id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
