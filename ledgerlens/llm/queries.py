"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bagminhash, chat, langid, license, mixing, packing, periodic, quality, repair, substring, viterbi, warc,
               winnowing)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through capture archives and deduplicated archives."""
    return warc.deduplicated_archive(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(encode(coalesce(html, ''))) AS payload_digest
  FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM w
"""


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier document has too."""
    return substring.repeated_passages(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings of all documents."""
    return license.scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bagminhash.classes(read_table(spark, sf_dir, "documents")).drop("digest")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), digest=True)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return winnowing.fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return viterbi.token_counts(read_table(spark, sf_dir, "documents"))


def op10_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with planted periodic tails."""
    planted = periodic.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.with_runs(planted))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    whole = read_table(spark, sf_dir, "conversations")
    return repair.repair_digests(repair.damaged(whole), whole)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation through its layout and the chat template, and back."""
    return chat.format_digests(chat.with_control_conversation(read_table(spark, sf_dir, "conversations")))


# The template's marks and the control strings that it escapes, each of which gets one character.
OP13_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
lengths AS (
  SELECT *, (SELECT CAST(sum((length(role || chr(0) || text) - length(replace(role || chr(0) || text, c, ''))) // length(c)) AS BIGINT)
             FROM (VALUES ('\'), ('<|im_start|>'), ('<|im_sep|>'), ('<|im_end|>'), ('<|endoftext|>'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'),
                   ('<<SYS>>'), ('<</SYS>>')) AS control(c)) AS escapes
  FROM rows),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(role) + length(text) + escapes + 32) AS BIGINT) AS formatted_chars,
    string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) AS roles, bool_and(role IN ('system', 'user', 'assistant')) AS usual
  FROM lengths GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = 'user assistant' THEN 'prompt' WHEN roles = 'system user assistant' THEN 'instruction' WHEN usual AND conv_id % 3 = 0
    THEN 'conversations' ELSE 'messages' END AS layout
FROM whole
"""


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_warc_revisits, op2_repeated_passages, op3_license_scan, op4_bagminhash, op5_best_fit_packing, op6_winnowing, op7_source_mix, op8_language_id, op9_token_counts,
                            op10_risk_controlled_rules, op11_periodic_runs, op12_conversation_repair, op13_chat_formatting)}
ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op13_chat_formatting": OP13_SQL}
