"""Corpus pipeline: quality classifier, near-duplicates, repeated substrings, benchmark decontamination, BPE ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import bpe, decontam, neardup, quality, substring
from feedloom.llm.shared import materialize, table

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("substring dedup", substring.stage),
    ("benchmark decontamination", decontam.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: The classifier's fitted weights and the tokenizer's merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
