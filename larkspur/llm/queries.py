"""Registered queries opN_<name> over whole tables, with the digests that their contracts name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chat import digest_conversations, format_conversations
from .divergence import source_divergence
from .html_extract import extract_pages
from .jaccard_join import jaccard_classes
from .lexicon import build_lexicon, decode, encode
from .packing import pack_documents
from .quality import quality_rules
from .repair import damage, digest_repaired, repair_conversations
from .shards import ShardStore
from .token_counts import count_tokens
from .topk import scaled, top_k
from .toxicity import toxicity
from .vector_dedup import near_copies

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(_read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 batches, are compacted and read back from the last version."""
    docs = _read(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{common.own_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(docs.withColumn("arrival", F.col("doc_id") % 16).withColumn("batch", F.col("arrival")), "batch")
    store.compact()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", F.col("arrival").cast("int").alias("arrival"), F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), vocabulary_path())


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_conversations(rows.unionByName(own)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1")
    out = quality_rules(_read(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    both = decode(encode(docs, vocabulary_path(), build_lexicon(docs, vocabulary_path())), vocabulary_path())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), vocabulary_path())


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damage(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return digest_repaired(repair_conversations(damaged, copies_col="copies"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_toxicity": op2_toxicity,
        "op3_html_extraction": op3_html_extraction,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sharding": op5_sharding,
        "op6_token_counts": op6_token_counts,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_quality_rules": op8_quality_rules,
        "op9_bpe_encoding": op9_bpe_encoding,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_structure_repair": op11_structure_repair,
        "op12_source_divergence": op12_source_divergence,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_SHARDS = """
SELECT doc_id, CAST(doc_id % 16 AS INTEGER) AS arrival, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5
FROM documents
"""


#: One turn after the other, with the best (cost, audit, lines) of each state: no matrices.
_REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x:
    list_reduce(list_prepend(xor(c, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(2) t(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)
), lined AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM lined
), turns AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM told
), steps(a, role, b) AS (
  VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), inserts(a, b, cost, audit, lines) AS (
  VALUES ('-', '-', 0, '', CAST([] AS VARCHAR[])), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('-', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('a', 'u', 2, 'I', ['user:']), ('u', 'a', 2, 'I', ['assistant:']),
    ('-', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:'])
), edits AS (
  SELECT t.conv_id, t.n, s.a, s.a AS b, 3 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines FROM turns t, (VALUES ('-'), ('s'), ('u'), ('a')) s(a)
  UNION ALL
  SELECT t.conv_id, t.n, s.a, s.b, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K', [t.role || ':' || t.text] FROM turns t JOIN steps s ON s.role = t.initial WHERE fault IN ('fine', 'truncated')
  UNION ALL
  SELECT t.conv_id, t.n, s.a, s.b, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R', [CASE s.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text]
  FROM turns t JOIN steps s ON s.role <> 's' WHERE fault IN ('fine', 'truncated')
), best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '-' AS state, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS v FROM conversations
  UNION ALL
  SELECT p.conv_id, e.n, e.b, min({'cost': p.v.cost + i.cost + e.cost, 'audit': p.v.audit || i.audit || e.audit, 'lines': p.v.lines || i.lines || e.lines})
  FROM best p JOIN inserts i ON i.a = p.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.a = i.b
  GROUP BY p.conv_id, e.n, e.b
), ended AS (
  SELECT p.conv_id, min({'cost': p.v.cost + i.cost, 'audit': p.v.audit || i.audit, 'lines': p.v.lines || i.lines}) AS v
  FROM best p JOIN inserts i ON i.a = p.state AND i.b IN ('-', 'a')
  WHERE p.n = (SELECT count(*) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY p.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(v.cost AS BIGINT) AS cost, v.audit AS audit, sha256(array_to_string(v.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT nr, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), terms AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT nr) >= 3
), kept AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM terms GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT g.lang, g.source, t.term, t.n AS of_lang, count(w.term) AS n
  FROM groups g JOIN terms t USING (lang) LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = t.term GROUP BY ALL
), shares AS (
  SELECT c.*, 1 + CAST(1000000000 AS HUGEINT) * (c.n + 1) // (CAST(sum(c.n) OVER (PARTITION BY c.lang, c.source) AS HUGEINT) + v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (of_lang + 1) // (CAST(k.n AS HUGEINT) + v) AS q
  FROM counts c JOIN kept k USING (lang)
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source LEFT JOIN shares b ON b.lang = g.lang AND b.source = h.source AND b.term = a.term
  GROUP BY ALL
), every AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


_NEAR_COPIES = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), found AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = found.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM found
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query.  The others are tested against brute force."""
    return {
        "op1_topk_search": _TOP_K,
        "op5_sharding": _SHARDS,
        "op11_structure_repair": _REPAIR,
        "op12_source_divergence": _DIVERGENCE,
        "op13_embedding_dedup": _NEAR_COPIES,
    }
