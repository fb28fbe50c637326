"""The contract queries of the training-data operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytepair, chat, exact_dedup, importance, language, mixing, near_dedup, packing, quality, tables, tokens, topk, warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(tables.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(tables.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, tables.read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", (~quality.learnable(F.col("doc_id"))).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    training = docs.filter(language.learnable(F.col("doc_id")))
    named = language.with_language(docs.select("doc_id", "text"), training)
    return named.select("doc_id", (~language.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(tables.read(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_epoch", "mix_block", "mix_order")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(tables.read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("t"))
    return chat.digests(chat.format_conversations(turns.unionByName(extra.select("t.*"))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.with_token_counts(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("weights"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("b").isNull(), F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    scored = alignment.link_scores(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bytepair.with_ids(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), *ranks).drop("text")
    back = F.sha2(bytepair.decoded("bpe_ids", *ranks), 256)
    return coded.select("doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"), bytepair.ids_digest("bpe_ids").alias("ids_sha256"), back.alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_packing, op3_quality, op4_language, op5_warc, op6_mixing, op7_near_dedup, op8_chat, op9_token_counts, op10_topk, op11_importance, op12_alignment, op13_byte_bpe)
    return {f.__name__: f for f in own}


_LOWERED = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"
_ESCAPED = "length({0}) + length({0}) - length(replace(replace(replace({0}, '\\', ''), '#', ''), '<', ''))"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)) & 31), 1)), '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWERED} AS norm FROM documents),
            g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
        "op5_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            h AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
            SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM h""",
        "op8_chat": f"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, x.turn, x.role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(14 + {_ESCAPED.format("role")} + length(role) - length(replace(role, ':', '')) + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op10_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
            QUALIFY rank <= 5""",
    }
