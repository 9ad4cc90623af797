"""The queries of the ten corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitweave.llm import decontaminate, imatch, jaccard, pagetext, pieces, pii, quality, toolcalls, toxicity, warc
from hitweave.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(spark, table(spark, sf_dir, "documents"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(spark, table(spark, sf_dir, "conversations"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), decoded=True)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard_join, op3_toxicity, op4_imatch, op5_tool_call_linking, op6_quality_classifier, op7_warc, op8_sentencepiece, op9_pii, op10_html_extraction)}
#: SHA-1 in base32, five hexadecimal digits at a time.
_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(sha1(payload), CAST(1 + 5 * (k // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31)::BIGINT, 1)), '')"""

ORACLES: dict[str, str] = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id, count(*) OVER (PARTITION BY payload_digest) AS copies FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN copies = 1 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN copies > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM w""",
}
