"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard_join, language_id, line_dedup, manifest, packing, prefix_trie, quality, substring_dedup, token_binary, token_counts
from .runtime import Scratch

#: The id that ends each document in packed and stored token streams.
END_ID = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID).read()


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    work = Scratch(spark, "chats")
    return chat.read_chats(work.table(chat.format_chats(rows.unionByName(extra)), "formatted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


_QUERIES = (
    op1_substring_dedup,
    op2_token_counts,
    op3_token_binary,
    op4_nearest_neighbours,
    op5_quality,
    op6_language_id,
    op7_jaccard_join,
    op8_packing,
    op9_chat_format,
    op10_decontamination,
    op11_line_dedup,
    op12_merkle_manifest,
    op13_prefix_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_CTL = "<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|<\\|role\\|>|<\\|text\\|>|<\\|end\\|>"

OP9_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END + length(text)
    + length(array_to_string(regexp_extract_all(text, '(\*)(?:{_CTL})', 1), '')) + len(regexp_extract_all(text, '{_CTL}'))
    + length(regexp_extract(text, '\*$')) AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a short ASCII string."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))"
    # each byte is folded into the low eight bits, then shifted out bit by bit
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, i, line, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs)),
repeated AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT l.*, r.key IS NULL OR l.doc_id IS NULL OR l.doc_id = r.last AS stays FROM lines l LEFT JOIN repeated r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY rid
"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS other FROM documents)),
nodes AS (
  SELECT lang, 0 AS level, pos AS idx, n AS size, leaf AS d FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, (size + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY lang, level, idx // 2, size),
tops AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE size = 1),
above AS (
  SELECT 0 AS level, pos AS idx, n AS size, subroot AS d FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, (size + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM above WHERE size > 1 GROUP BY level, idx // 2, size),
fold AS (
  SELECT rid, lang, 0 AS level, pos AS idx, n AS size, coalesce(other, leaf) AS d, CAST(NULL AS VARCHAR) AS sib FROM leaves
  UNION ALL
  SELECT f.rid, f.lang, f.level + 1, f.idx // 2, (f.size + 1) // 2,
    sha256(CASE WHEN f.idx % 2 = 0 THEN f.d || coalesce(s.d, '') ELSE coalesce(s.d, '') || f.d END), s.d
  FROM fold f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.size > 1),
higher AS (
  SELECT f.rid, 0 AS level, t.pos AS idx, t.n AS size, f.d, CAST(NULL AS VARCHAR) AS sib FROM fold f JOIN tops t ON t.lang IS NOT DISTINCT FROM f.lang WHERE f.size = 1
  UNION ALL
  SELECT f.rid, f.level + 1, f.idx // 2, (f.size + 1) // 2,
    sha256(CASE WHEN f.idx % 2 = 0 THEN f.d || coalesce(s.d, '') ELSE coalesce(s.d, '') || f.d END), s.d
  FROM higher f LEFT JOIN above s ON s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.size > 1),
proofs AS (
  SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY stage, level), '')) AS proof
  FROM (SELECT rid, 0 AS stage, level, sib FROM fold UNION ALL SELECT rid, 1, level, sib FROM higher) GROUP BY rid)
SELECT l.doc_id, l.leaf, t.subroot, r.d AS root, p.proof AS proof_sha256, h.d AS folded_root, h.d = r.d AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN proofs p USING (rid)
  JOIN (SELECT rid, d FROM higher WHERE size = 1) h USING (rid) CROSS JOIN (SELECT d FROM above WHERE size = 1) r
"""

OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
paths AS (SELECT conv_id, depth, size, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM steps),
passes AS (SELECT conv_id, depth, size, path, above FROM paths UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS (SELECT path, above, depth, size, count(*) AS n, min(conv_id) AS conv_id FROM passes GROUP BY ALL),
kids AS (SELECT above AS path, count(*) AS many FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
  SELECT p.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((d.n - 1) * d.size) AS saved
  FROM nodes d LEFT JOIN kids k ON k.path = d.path JOIN passes own ON own.path = d.path AND own.conv_id = d.conv_id
    JOIN passes p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.path),
ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM passes GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.many, 0) AS n_children,
  s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.path = n.above LEFT JOIN kids k ON k.path = n.path JOIN sums s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": OP9_SQL, "op11_line_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_prefix_trie": OP13_SQL}
