"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, chat, jaccard, line_dedup, packing, passages, personal_data, prefix_trie, quality, token_counts, topk_search, vector_dedup


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir: str):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_chat_formatting(spark, sf_dir: str):
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_byte_bpe(spark, sf_dir: str):
    where = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.round_trip(docs, *where)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark, sf_dir: str):
    out = passages.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words_removed", "removed", "text")


def packing_tokenizer() -> tuple:
    """byte_bpe_50k as ranks, with the special token of its .json: the same ids, several times faster."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)


def op5_packing(spark, sf_dir: str):
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), packing_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_dedup(spark, sf_dir: str):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark, sf_dir: str):
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_topk_search(spark, sf_dir: str):
    return topk_search.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 100 = 0")


def op9_quality(spark, sf_dir: str):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.expr(quality.HELD_OUT).alias("held_out"), "score", "predicted")


def op10_vector_dedup(spark, sf_dir: str):
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_personal_data(spark, sf_dir: str):
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark, sf_dir: str):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_chat_formatting, op3_byte_bpe, op4_substring_dedup, op5_packing, op6_line_dedup, op7_jaccard_join, op8_topk_search, op9_quality,
        op10_vector_dedup, op11_personal_data, op12_prefix_trie
    )
}

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id != q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL = {
    "op2_chat_formatting": chat.FORMAT_CHATS_SQL,
    "op6_line_dedup": line_dedup.DEDUP_LINES_SQL,
    "op8_topk_search": OP8_SQL,
    "op11_personal_data": personal_data.PERSONAL_DATA_SQL,
    "op12_prefix_trie": prefix_trie.PREFIX_TRIE_SQL,
}
