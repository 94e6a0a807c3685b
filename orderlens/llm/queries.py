"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import ann, bpe, chat, decontam, filter_audit, jaccard_join, lm, pii, quality, secret_scan, sharding, toxicity, vector_codes
from orderlens.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the training folds."""
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every whole document."""
    return pii.digests(spark, table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all whole documents, after the forest."""
    return secret_scan.scan(spark, table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole document by the self-attention model."""
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by five-word shingles, all pairs settled."""
    return jaccard_join.join(spark, table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of benchmark items in all whole documents."""
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the 49k word BPE vocabulary."""
    return bpe.bpe(spark, table(spark, sf_dir, "documents"), with_text=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws from the whole table."""
    return quality.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    return chat.chat_digests(spark, table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector coded by eight codebooks refined over all vectors."""
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all 120 orders of five filters over whole documents."""
    return filter_audit.interactions(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, permuted by its global row number."""
    return sharding.digests(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_lm": op4_lm,
    "op5_jaccard": op5_jaccard,
    "op6_ann": op6_ann,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

#: A turn's text is escaped when it holds the mark that closes it or a string
#: that already looks escaped; each control string then gets one character.
_CLOSE = "CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END"
_MARKS = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) + length(CAST(length(role) AS VARCHAR)) END"


def _controls(backslashes: str) -> str:
    marks = ["<</SYS>>", "<<SYS>>", "[/INST]", "[/ROLE]", "[INST]", "[ROLE ", "</s>", "<s>"]
    quoted = [m[0].replace("[", r"\[") + backslashes + m[1:].replace("]", r"\]") for m in marks]
    return "'" + "|".join(quoted) + "'"


ORACLE_SQL: dict[str, str] = {
    "op10_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(text) + {_MARKS}
    + CASE WHEN contains(text, {_CLOSE}) OR regexp_matches(text, {_controls(r'\\+')})
           THEN len(regexp_extract_all(text, {_controls(r'\\*')})) ELSE 0 END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_sharding": sharding.oracle_sql(),
}
