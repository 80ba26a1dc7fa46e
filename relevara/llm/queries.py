"""The thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.collocations import collocations
from relevara.llm.common import documents, held_out
from relevara.llm.exact_dedup import exact_dedup
from relevara.llm.inner_product import norm_sorted_search
from relevara.llm.language_id import identify
from relevara.llm.maxent_lm import maxent_scores
from relevara.llm.mixing import mix
from relevara.llm.ngram_jaccard import jaccard_components
from relevara.llm.packing import pack
from relevara.llm.prefix_trie import prefix_trie
from relevara.llm.projection_forest import forest_search
from relevara.llm.quality import quality_scores
from relevara.llm.sanitise import KINDS, REMOVE_SHARE, find_spans, span_text
from relevara.llm.tool_calls import linked_chats


def vocabulary() -> str:
    """The tokenizer's file; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), vocabulary())


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark, documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731 - a second argument of the inner one would be the place
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    removed = F.filter(F.coalesce(F.map_values("shares"), F.array().cast("array<double>")), lambda s: s >= REMOVE_SHARE)
    terms = [F.size(F.filter("all", lambda s: s["kind"] == KINDS.index("term"))).cast("long").alias("n_term"), F.size(removed).cast("long").alias("n_removed")]
    return found.select("doc_id", *count, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("all")).alias("spans"), *terms)


#: What the answers of a conversation are as a tool.
ANSWER_TOOL = '{"tools":[{"name":"answer","parameters":{"required":["question","n_chars"],"properties":{"question":{"type":"string"},"n_chars":{"type":"integer"}}}}]}'


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """Conversations with their exchanges as tool traffic, turns at every fourth number.

    The first turn is preceded by the tool's declaration; each turn of the user is followed by a call whose arguments
    come from its text and which builds on the call of the exchange before; each turn of the assistant
    is preceded by the result of the turn before it.  Turns with JSON of their own stay as they are.
    """
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    own = conversations.select("conv_id", (turn * 4 + 2).alias("turn"), F.col("role").cast("string").alias("role"), "text")
    args = F.struct(text.alias("question"), F.length(text).alias("n_chars"))
    call = F.struct(F.array(F.struct(name(turn).alias("id"), F.lit("answer").alias("name"), args.alias("arguments"), F.array(name(turn - 2)).alias("after"))).alias("tool_calls"))
    result = F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content"))
    asked, answered = conversations.filter(F.col("role") == "user"), conversations.filter(F.col("role") == "assistant")
    told = conversations.filter(turn == 0).select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(ANSWER_TOOL).alias("text"))
    calls = asked.select("conv_id", (turn * 4 + 3).alias("turn"), F.lit("assistant").alias("role"), F.to_json(call).alias("text"))
    results = answered.select("conv_id", (turn * 4 + 1).alias("turn"), F.lit("tool").alias("role"), F.to_json(result).alias("text"))
    return own.unionByName(told).unionByName(calls).unionByName(results)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, their exchanges as calls of a declared tool with their results."""
    return linked_chats(spark, as_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark, documents(spark, sf_dir), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text", held_out(F.col("doc_id"), 4).alias("held_out"))
    return identify(spark, docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_scores(spark, documents(spark, sf_dir), held_out(F.col("doc_id"), 7))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_sorted_search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    taken = F.crc32(conv.cast("string").cast("binary")) % 4
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 20, taken)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_best_fit_packing,
        op3_pii_sanitisation,
        op4_tool_call_linking,
        op5_ngram_jaccard_join,
        op6_source_mixing,
        op7_language_id,
        op8_lm_scoring,
        op9_exact_dedup,
        op10_exact_top_k,
        op11_nearest_neighbours,
        op12_collocations,
        op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
), ids AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS k FROM sets),
nodes AS (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM ids WHERE n > 0 GROUP BY k),
items AS (SELECT node, n, unnest(s) AS g FROM nodes JOIN sets ON sets.doc_id = nodes.node),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.g = b.g AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, label) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node
), labels AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
SELECT ids.doc_id, CAST(ids.n AS BIGINT) AS n_shingles, CAST(coalesce(l.component_id, ids.doc_id) AS BIGINT) AS component_id
FROM ids LEFT JOIN nodes ON ids.n > 0 AND nodes.k = ids.k LEFT JOIN labels l ON l.node = nodes.node
""",
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY h) AS c,
    first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep
  FROM t
)
SELECT doc_id, keep AS keep_id, CAST(c AS BIGINT) AS group_size, rn = 1 AS kept, h AS text_sha256 FROM r
""",
    "op10_exact_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op12_collocations": r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
runs AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM runs, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, k, g, count(*) AS a, string_split(g, ' ') AS w FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
spans AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM f WHERE k > 2))
), longer AS (SELECT lang, g, max(a) AS longer FROM spans GROUP BY lang, g),
cuts AS (
  SELECT f.lang, f.g, f.a, f.w, unnest(range(1, f.k)) AS c FROM f LEFT JOIN longer x ON x.lang = f.lang AND x.g = f.g WHERE f.k > 1 AND coalesce(100 * x.longer, 0) < 80 * f.a
), scored AS (
  SELECT c.lang, c.g, c.a, c.c, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:c.c], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[c.c + 1:], ' ')
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM least) JOIN total USING (lang) WHERE rank <= 2000
""",
    "op13_conversation_trie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)
), turns AS (
  SELECT h.c, o.pos, o.role, o.text FROM heads h JOIN own o ON o.c = h.c - h.c % 20 AND o.pos <= h.h
  UNION ALL
  SELECT h.c, o.pos - h.h + coalesce(b.k, 0), o.role, o.text FROM heads h JOIN own o ON o.c = h.c AND o.pos > h.h
    LEFT JOIN (SELECT h.c, count(*) AS k FROM heads h JOIN own o ON o.c = h.c - h.c % 20 AND o.pos <= h.h GROUP BY h.c) b ON b.c = h.c
), seqs AS (
  SELECT h.c, coalesce(list({'role': t.role, 'text': t.text} ORDER BY t.pos) FILTER (t.pos IS NOT NULL), []) AS s FROM heads h LEFT JOIN turns t ON t.c = h.c GROUP BY h.c
), reach AS (
  SELECT c, len(s) AS n, d, min(c) OVER (PARTITION BY s[1:d], d) AS node, len(list_filter(regexp_split_to_array(s[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT node, d, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE max(words) END AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS sha
  FROM reach GROUP BY node, d
), linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN reach p ON p.c = n.node AND p.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.node = l.node AND k.d = l.d),
sums AS (
  SELECT a.node, a.d, sum((f.n_convs - 1) * f.words) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM full_ f JOIN reach a ON a.c = f.node AND a.d <= f.d GROUP BY a.node, a.d
)
SELECT CAST(f.node AS BIGINT) AS conv_id, CAST(f.d AS BIGINT) AS depth, CAST(f.parent AS BIGINT) AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.sha AS ends_sha256
FROM full_ f JOIN sums s ON s.node = f.node AND s.d = f.d
""",
}
