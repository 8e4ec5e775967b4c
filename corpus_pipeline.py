"""A training-corpus pipeline over ``documents`` from four of the operators.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, packing, quality, queries, simhash
from tessera.llm.common import materialize

#: The stages can't be expressed in SQL (SimHash, tokens); tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents below the base rules, or that lost too much text, go.

    Null and empty texts have no words and go; equal rows are judged alike and
    repeat; very long texts are judged whole; an empty table stays empty; other
    columns, of any name, stay as they are.
    """
    return quality.cleaned(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or near lines the first stays, by doc_id, hash of the text and place.

    Equal lines are found at any length.  No row goes; a null text stays null
    and a text may become empty; identical rows are cleaned alike; a null doc_id
    comes last; an empty table stays empty; other columns, of any name, stay.
    """
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints one row stays: the least doc_id, then the least hash of the text.

    That goes by row: repeated rows and rows that share an id are copies like
    any other.  Null doc_ids come last.  Null and empty texts have one
    fingerprint, so one of them stays.  An empty table stays empty; other
    columns, of any name, stay.
    """
    return simhash.first_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences; a null text is empty and has its end id alone.

    Long texts are cut; repeated rows and shared ids are packed row by row; an
    empty table has no pieces; other columns are dropped.
    """
    return packing.packed_documents(docs.select("doc_id", "text"), queries.BYTE_VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
