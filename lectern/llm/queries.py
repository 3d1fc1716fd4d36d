"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chunk_dedup import chunk_dedup
from .embed_dedup import near_embeddings
from .fertility import quality_measures
from .jaccard_join import jaccard_join
from .mixing import mix
from .packing import pack_documents
from .secret_scan import scan_secrets, secret_digest
from .sharding import shard_documents
from .suffix_dedup import suffix_dedup
from .warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept", "n_shingles")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy"
    return quality_measures(_table(spark, sf_dir, "documents")).select(*columns)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_fertility that SQL can express."""
    return quality_measures(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"))


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_suffix_dedup, op3_warc, op4_mix, op5_secret_scan, op6_chunk_dedup, op7_fertility, op8_pack, op9_near_embeddings, op10_jump_shards, quality_base_counts)
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op5_secret_scan": oracles.SECRET_SCAN,
    "op10_jump_shards": oracles.JUMP_SHARDS,
    "quality_base_counts": oracles.QUALITY_BASE,
    "op1_jaccard_join": r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM split WHERE len(w) > 0),
gram AS (SELECT doc_id, unnest(g) AS s FROM grams),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM gram a JOIN gram b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN grams a ON a.doc_id = x JOIN grams b ON b.doc_id = y WHERE 5 * n >= 4 * (len(a.g) + len(b.g) - n)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links,
       d.doc_id <= coalesce(c.low, d.doc_id) AS kept, coalesce(len(g.g), 0) AS n_shingles
FROM documents d LEFT JOIN class c ON c.x = d.doc_id LEFT JOIN degree e ON e.x = d.doc_id LEFT JOIN grams g ON g.doc_id = d.doc_id""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lowest FROM pages),
five AS (SELECT page_id, h, lowest, list_transform(range(8), lambda g: ('0x' || substr(sha1(h), (5 * g + 1)::INT, 5))::INT) AS f FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(f, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lowest THEN lowest END AS refers_to
FROM five""",
    "op9_near_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN class c ON c.x = vec_id LEFT JOIN degree d ON d.x = vec_id""",
}
