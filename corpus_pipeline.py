"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, encoding; each stage's table is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartermill.llm._common import Scratch, table
from quartermill.llm.codec import encoding_stage
from quartermill.llm.language import language_stage
from quartermill.llm.mixing import mixing_stage
from quartermill.llm.near_dup import near_dup_stage
from quartermill.llm.secret_scan import secrets_stage

STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Fingerprints, hashed shuffles and merges of tokens are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, ids and n_tokens of each document of the mix."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)  # a stage's table, not the input
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
