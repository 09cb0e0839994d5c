"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.bpe import encode_documents
from quaymark.llm.common import documents
from quaymark.llm.exact_dedup import exact_dedup
from quaymark.llm.language import language_id
from quaymark.llm.maxent import score
from quaymark.llm.minhash import near_duplicates
from quaymark.llm.mixing import mix
from quaymark.llm.quality import quality
from quaymark.llm.suffix_dedup import suffix_dedup
from quaymark.llm.token_store import token_store
from quaymark.llm.warc import derivatives, responses


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derived records of every page. Files of them are what write_warc() makes and read_warc() reads."""
    records = responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return derivatives(records, ["page_id"]).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"), F.octet_length("block").cast("long").alias("n_bytes"), F.decode("block", "utf-8").alias("content"),
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, threshold_pct=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"]
    return quality(documents(spark, sf_dir)).select(*cols)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = mix(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_exact_dedup, op4_warc, op5_token_store, op6_minhash, op7_quality, op8_mixing, op9_maxent, op10_language)}

ORACLES = {
    "op3_exact_dedup": r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
}
