"""Token counts (operator 2): prefix dynamic programming keeps the exact token count of every prefix.

For each distinct piece of text the programme finds, prefix by prefix, the one token that can stand last, and from it the
prefix's count; a text's prefix table adds these up at its chunk ends. Truncation points and budget answers come from the
table, without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quartermill.llm._common import columns_of, map_texts, table
from quartermill.llm.wordbpe import PrefixTable, WordBpe

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


@lru_cache(maxsize=2)
def tables_of(spec: str) -> WordBpe:
    """One set of merge tables for each Python worker."""
    return WordBpe(spec)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shipped(spark: SparkSession, path: str | None):
    """The tokenizer file, read on the driver and broadcast: a vocabulary's size is fixed, whatever the data."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars of every row.

    fit_chars: code points of the text's prefix that has at most `limit` tokens and more with the next code point; the
    text's length where all fits.
    A null text counts as empty: 0 bytes, 0 tokens. Rows with the same doc_id, or the same row twice, each give a row.
    Columns besides doc_id and text aren't read, whatever their names. An empty table gives no rows.
    Narrow: no shuffle; a worker holds one batch and caches of bounded size.
    """
    spec = shipped(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(spec.value)
        for batch in batches:
            ids, texts = columns_of(batch, "doc_id", "text")
            sizes, counts, fits = [], [], []
            for text in texts:
                text = text or ""
                prefixes = PrefixTable(tables, text)
                sizes.append(len(text.encode()))
                counts.append(prefixes.total)
                fits.append(prefixes.cut(limit))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return map_texts(docs.select("doc_id", "text"), count, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
