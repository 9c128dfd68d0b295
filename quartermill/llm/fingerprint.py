"""Document fingerprints (operator 4): canonical exact digests.

The canonical text is the Unicode compatibility form, case folded, white space folded to single spaces. Its fingerprint is a
128-bit xxHash. Documents of equal hash form a bucket; inside it each canonical text is compared with the bucket's first byte for
byte, and one that differs gets a longer fingerprint, so fingerprints are equal exactly when canonical texts are.

Texts travel once, compressed, to range buckets of doc_id and text hash, as many as their bytes ask for, where each meets the next;
the first document of each bucket is sent to the one before as well. Only documents that share a hash leave their canonical text
behind for the comparison.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, columns_of, map_texts, table

#: Bytes of text for a bucket.
BUCKET_BYTES = 64 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(own: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(own)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, bytes and fingerprint (before any comparison) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, texts = columns_of(batch, "doc_id", "text_hash", "text")
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(canonical(t or "")) for t in texts], pa.string())], names=["doc_id", "text_hash", "size", "fp"])

    return map_texts(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), run, "doc_id long, text_hash long, size long, fp string")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next doc_id, after the last the first; rows with one doc_id follow each other by a
    hash of their texts. near_*: 1 where the canonical texts are equal, byte for byte, else 0. A null text counts as empty. A
    null doc_id comes first. A single row is its own next. Columns besides doc_id and text aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    own = scratch.keep(digests(docs))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(own.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    ranged = own.select("doc_id", "text_hash").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc())
    starts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).collect()  # a row a bucket
    order = lambda key, text_hash: (key is not None, key or 0, text_hash)
    starts = sorted(order(*r["first"]) for r in starts)
    # by the first document of a bucket, the bucket before it; the first of all goes to the last
    ahead = {first: (n - 1) % len(starts) for n, first in enumerate(starts)}
    shipped = spark.sparkContext.broadcast((starts, ahead))  # three numbers a bucket

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        starts, ahead = shipped.value
        for batch in batches:
            rows = []
            for key, text_hash, text in zip(*columns_of(batch, "doc_id", "text_hash", "text")):
                packed = pack((text or "").encode())
                own = order(key, text_hash)
                rows.append((bisect_right(starts, own) - 1, 0, key, 1, text_hash, packed))
                if own in ahead:
                    rows.append((ahead[own], 1, key, 1, text_hash, packed))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "ahead", "doc_id", "kind", "text_hash", "packed"])

    schema = "bucket int, ahead int, doc_id long, kind int, text_hash long, packed binary"
    sent = map_texts(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), send, schema)
    shared = own.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("first")).where("n > 1").select("fp", "first")
    marked = scratch.keep(own.join(scratch.keep(shared), "fp").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.col("first")).alias("is_first")).distinct())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, firsts = columns_of(batch, "doc_id", "text_hash", "is_first")
            n, starts = len(keys), shipped.value[0]
            yield pa.record_batch([pa.array([bisect_right(starts, order(k, h)) - 1 for k, h in zip(keys, hashes)], pa.int32()), pa.array([0] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(hashes, pa.int64()), pa.array([b"first" if f else b"" for f in firsts], pa.binary())], names=["bucket", "ahead", "doc_id", "kind", "text_hash", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.binary())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "is_first", "canonical"]
        out: list[tuple] = []
        bucket, waiting, marks, marks_of, done = None, None, {}, None, False

        def result(doc: tuple, following: tuple) -> tuple:
            key, text_hash, text, own, flag = doc
            changed = edited(text, following[2])
            other = canonical(changed)
            return key, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own), digest(other), float(own == other), float(own == following[3]), flag is True, None if flag is None else pack(own)

        for batch in batches:
            for at, late, key, kind, text_hash, packed in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if at != bucket:
                    bucket, waiting, marks, marks_of, done = at, None, {}, None, False
                if key != marks_of:
                    marks, marks_of = {}, key
                if kind == 0:
                    marks[text_hash] = packed == b"first"
                    continue
                if done:
                    continue
                text = unpack(packed).decode() if packed else ""
                doc = (key, text_hash, text, canonical(text), marks.get(text_hash))
                if waiting is not None:
                    out.append(result(waiting, doc))
                waiting, done = doc, bool(late)
                if len(out) >= 500:
                    yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
                    out = []
        if out:
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    gathered = sent.unionByName(map_texts(marked, mark, schema)).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "kind", "text_hash")
    met = scratch.keep(map_texts(gathered, meet, RESULT + ", is_first boolean, canonical binary"))
    return _compared(met, scratch)


def _compared(met: DataFrame, scratch: Scratch) -> DataFrame:
    """met, a fingerprint lengthened where its canonical text isn't that of its bucket's first.

    Both sides of the comparison are stored tables, so that Spark can split a bucket with many copies.
    """
    first = scratch.keep(met.where("is_first").select("fingerprint", F.col("canonical").alias("of_first")).dropDuplicates(["fingerprint"]))
    unlike = met.where("canonical IS NOT NULL").select("doc_id", "fingerprint", "canonical").join(first, "fingerprint").where("canonical != of_first")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = [(key, fp, f"{fp}-{xxhash.xxh64_hexdigest(unpack(own), 1)}", own) for key, fp, own, other in zip(*columns_of(batch, "doc_id", "fingerprint", "canonical", "of_first")) if unpack(own) != unpack(other)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "fingerprint", "longer", "canonical"])

    apart = map_texts(unlike.select("doc_id", "fingerprint", "canonical", "of_first"), differ, "doc_id long, fingerprint string, longer string, canonical binary")
    names = [c.split()[0] for c in RESULT.split(", ")]
    if not apart.take(1):
        return met.select(*names)
    longer = apart.distinct().select(F.col("fingerprint").alias("_fp"), F.col("canonical").alias("_own"), "longer").dropDuplicates(["_fp", "_own"])
    return met.join(longer, (F.col("fingerprint") == F.col("_fp")) & (F.col("canonical") == F.col("_own")), "left").withColumn("fingerprint", F.coalesce("longer", "fingerprint")).select(*names)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
