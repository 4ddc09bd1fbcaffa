"""The queries of this folder's operators over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, mixing, quality, secrets, simhash, token_count, toxicity, warc

#: Shares of the mixed characters. src0 is by far the largest source; the sources that aren't listed share the rest.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.08}
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).drop("key")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{tricky}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(chat.format_trees(chat.from_turns(rows.unionByName(extra))))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(read(spark, sf_dir, "documents")).drop("key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_simhash, op3_chat, op4_token_count, op5_bpe, op6_warc, op7_exact_dedup, op8_toxicity, op9_quality, op10_secrets)
}

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
ORACLE_SQL = {
    "op1_mixing": mixing.mix_sql(MIX_WEIGHTS),
    "op3_chat": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(chat.TURN + chat.BODY + chat.END)}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
""",
    "op6_warc": f"""
WITH paid AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS low FROM paid),
typed AS (SELECT *, payload_bytes >= {warc.LEAST_REVISIT} AND low IS NOT NULL AND page_id IS DISTINCT FROM low AS again FROM first)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN low END AS refers_to FROM typed
""",
    "op9_quality": quality.judge_sql(),
    "op7_exact_dedup": f"""
WITH norm AS (SELECT doc_id, {LOWER_SQL} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM norm
""",
}
