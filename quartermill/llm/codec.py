"""BPE encoding and decoding (operator 9): a streaming transducer with bounded lookahead, and its inverse.

The merge list gives the number of letters after a boundary that can decide what is merged across it. A token that ends
further back than that is stable and leaves the buffer, so a piece of any length needs constant memory. Decoding runs
tokens through a byte-to-text machine that holds at most one unfinished character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import columns_of, map_texts, table
from quartermill.llm.tokens import shipped, tables_of
from quartermill.llm.wordbpe import StreamDecoder, WordBpe


def _decoded(tables: WordBpe, ids: list[int], spelled: bool) -> str:
    stream = StreamDecoder(tables, spelled)
    return "".join(stream.feed(ids[at : at + 1024]) for at in range(0, len(ids), 1024)) + stream.finish()


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null text has no ids."""
    spec = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(spec.value)
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            for at in range(0, len(keys), 500):
                yield pa.record_batch([pa.array(keys[at : at + 500], pa.int64()), pa.array([tables.encode(t or "") for t in texts[at : at + 500]], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None, spelled: bool = False) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; spelled: as the library spells tokens of a file without a decoder."""
    spec = shipped(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(spec.value)
        for batch in batches:
            keys, lists = columns_of(batch, "doc_id", "ids")
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([_decoded(tables, ids or [], spelled) for ids in lists], pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the ids as little-endian 32-bit words, and the decoded text.

    A null text counts as empty. Rows with the same doc_id, or the same row twice, each give a row. Columns besides doc_id
    and text aren't read. An empty table gives no rows. Narrow: ids go from the encoder to the decoder part by part.
    """
    spec = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(spec.value)
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            sizes, own, back = [], [], []
            for text in texts:
                stream, n, of_ids, of_text = StreamDecoder(tables, spelled=True), 0, hashlib.sha256(), hashlib.sha256()
                for ids in tables.encoded(text or ""):
                    n += len(ids)
                    of_ids.update(np.array(ids, "<u4").tobytes())
                    of_text.update(stream.feed(ids).encode())
                of_text.update(stream.finish().encode())
                sizes.append(n)
                own.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the encoded corpus, a row for each row of docs with its ids and their number."""
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))
