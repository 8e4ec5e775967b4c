"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_codec, fingerprint, html_extract, license_scan, line_dedup, packing, quality, sharding, simhash, token_files
from tessera.llm.common import read_table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(fingerprint.fingerprinted(_documents(spark, sf_dir)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(quality.assess(_documents(spark, sf_dir)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir), BYTE_VOCABULARY)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(_documents(spark, sf_dir)))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode_decode(_documents(spark, sf_dir), BYTE_VOCABULARY))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), WORD_VOCABULARY)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digests(html_extract.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir))


def op9_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.members(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.kd_shards(read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": op1_fingerprint,
        "op2_quality": op2_quality,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_token_files": op6_token_files,
        "op7_license_scan": op7_license_scan,
        "op8_html_extract": op8_html_extract,
        "op9_line_dedup": op9_line_dedup,
        "op9_line_classes": op9_line_classes,
        "op10_sharding": op10_sharding,
    }


def oracles() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    from tessera.llm import oracles as sql

    return sql.oracles()
