"""SimHash near-duplicates (operator 3): a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and cut into blocks of equal size. A
block's node holds the mask and value of the bits its fingerprints share; FAN nodes in a row make an upper node with the bits
these share, and so on up to one root. The search goes down from the pair of the root with itself: a pair of nodes carries the
differences accumulated on the bits that both share, children add those of the bits they share besides, and a pair beyond the
bound goes with all below it. Every level is an equi-join of tables, so neither a task nor the driver holds all nodes. Blocks
left in a pair meet in a task, where nodes of LEAF fingerprints are pruned alike before single ones are compared. A task keeps a
forest of the links it finds, never all pairs.

A wider fingerprint (documents_kept) serves a similarity bound of 0.8: there shared masked bit patterns are the upper nodes,
several tables of them, each again in Gray order below. Its bits only propose groups; inside a group the shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, columns_of, free_name, map_texts, table
from quartermill.llm.components import connected_components

SEED = 42
BLOCK = 8192
LEAF = 64
FAN = 64
#: Guest blocks that meet a host block in one task.
GUESTS_BITS = 5
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; fewer words than `size`: of the whole sequence; no word: none."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white space characters alone
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    layout = b" ".join([b"%b"] * size)
    return np.fromiter((h(layout % own, SEED) for own in zip(*(words[k:] for k in range(size)))), np.uint64, len(words) - size + 1)


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of the same shingles for each lane; lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & int(ONES))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int = 1) -> tuple[int, ...]:
    """For each lane, the bits that are set in over half the hashes."""
    out = []
    for lane in range(lanes):
        own = mixed(hashes, lane).astype("<u8")
        total = np.zeros(64, np.int64)
        for at in range(0, len(own), 65536):
            total += np.unpackbits(own[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(total * 2 > len(own), bitorder="little").view("<u8")[0]) if len(own) else 0)
    return tuple(out)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


# ---- the index ---------------------------------------------------------------------------------------------------------


def shared_bits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and value of the bits that are alike in all rows; rows: (n, lanes)."""
    every, some = np.bitwise_and.reduce(rows, 0), np.bitwise_or.reduce(rows, 0)
    mask = ~(every ^ some)
    return mask, every & mask


class Nodes:
    """Fingerprints (n, lanes) in Gray order with their leaf nodes."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.begin = np.arange(0, len(rows), LEAF)
        every, some = np.bitwise_and.reduceat(rows, self.begin, 0), np.bitwise_or.reduceat(rows, self.begin, 0)
        self.mask = ~(every ^ some)
        self.value = every & self.mask
        pad = -len(rows) % LEAF
        self.padded = np.concatenate([rows, np.repeat(rows[-1:], pad, 0)]) if pad else rows


def differing(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(-1, dtype=np.int32)


def links(a: Nodes, b: Nodes, most: int, settled=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of rows at most `most` bits apart, in tiles. a is b: pairs within, once or twice.

    settled(i, j): tells which pairs of leaves need no look any more.
    """
    same = a is b
    step = max(1, (1 << 22) // max(1, len(b.begin) * a.rows.shape[1]))
    for at in range(0, len(a.begin), step):
        apart = (a.value[at : at + step, None] ^ b.value[None]) & a.mask[at : at + step, None] & b.mask[None]
        i, j = np.nonzero(differing(apart) <= most)
        i += at
        if same:
            i, j = i[i <= j], j[i <= j]
        for t in range(0, len(i), 256):
            p, q = i[t : t + 256], j[t : t + 256]
            if settled is not None:
                todo = ~settled(p, q)
                p, q = p[todo], q[todo]
                if not len(p):
                    continue
            lanes = a.rows.shape[1]
            left, right = a.padded.reshape(-1, LEAF, lanes)[p], b.padded.reshape(-1, LEAF, lanes)[q]
            near = np.zeros((len(p), LEAF, LEAF), np.int32)
            for lane in range(lanes):
                near += np.bitwise_count(left[:, :, None, lane] ^ right[:, None, :, lane])
            k, x, y = np.nonzero(near <= most)
            x, y = p[k] * LEAF + x, q[k] * LEAF + y
            real = (x < len(a.rows)) & (y < len(b.rows))
            if same:
                real &= x < y
            if real.any():
                yield x[real], y[real]


class Forest:
    """Labels of nodes 0..n-1, joined by links; the least index of a component is its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[x], label[y]
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def edges(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, name of its label) where they differ."""
        k = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return names[k], names[self.label[k]]


def node_levels(blocks: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of nodes from the blocks up to one root: id, parent, mask, value. blocks: block, mask, value; ids in Gray order."""
    levels, own, ids = [], blocks.select(F.col("block").alias("id"), "mask", "value"), 2
    while ids > 1:
        own = scratch.keep(own.withColumn("parent", F.expr(f"id div {FAN}")))
        levels.append(own)
        ids = own.select("parent").distinct().limit(2).count()
        every, some = F.bit_and("value"), F.bit_or("value")
        mask = F.bit_and("mask").bitwiseAND(F.bitwise_not(every.bitwiseXOR(some)))
        own = own.groupBy(F.col("parent").alias("id")).agg(mask.alias("mask"), every.bitwiseAND(mask).alias("value"))
    return levels


def block_pairs(levels: list[DataFrame], most: int, scratch: Scratch) -> DataFrame:
    """a, b (a <= b): blocks that may hold a link, by accumulated differences from the root down."""
    pairs = None
    for level in reversed(levels):
        a, b = (level.select(F.col("id").alias(x), F.col("parent").alias(f"{x}_up"), F.col("mask").alias(f"{x}_mask"), F.col("value").alias(f"{x}_value")) for x in "ab")
        if pairs is None:  # the root's children have one parent
            met = a.join(b, F.col("a_up") == F.col("b_up")).withColumns({"up_mask": F.lit(0).cast("long"), "sum": F.lit(0)})
        else:
            met = pairs.join(a, "a_up").join(b, "b_up")
        both = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        added = F.bit_count(F.col("a_value").bitwiseXOR(F.col("b_value")).bitwiseAND(both).bitwiseAND(F.bitwise_not("up_mask")))
        met = met.where("a <= b").select(F.col("a").alias("a_up"), F.col("b").alias("b_up"), both.alias("up_mask"), (F.col("sum") + added).cast("int").alias("sum")).where(F.col("sum") <= most)
        pairs = scratch.keep(met)
    return pairs.select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))


def near_links(distinct: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the fingerprints just as all links of at most `most` bits would.

    distinct: fp long (the bits), rank long (Gray rank less 2**63), no fp twice.
    """
    spark = distinct.sparkSession
    blocks = max(1, -(-distinct.count() // BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.asarray(b.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) for b in batches]
        rows = np.concatenate(own) if own else np.zeros(0, np.uint64)
        if len(rows):
            rows = rows[np.argsort(gray_rank(rows), kind="stable")]
            mask, value = shared_bits(rows[:, None])
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array(mask.view(np.int64)), pa.array(value.view(np.int64)), pa.array([rows.tobytes()], pa.binary())], names=["block", "mask", "value", "packed"])

    packed = scratch.keep(distinct.repartitionByRange(blocks, "rank").select("fp").mapInArrow(pack, "block long, mask long, value long, packed binary"))
    pairs = block_pairs(node_levels(packed, scratch), most, scratch)
    host = F.when((F.col("a") + F.col("b")) % 2 == 0, F.col("a")).otherwise(F.col("b"))  # the two of a pair take turns as host
    dealt = scratch.keep(pairs.select(host.alias("host"), (F.col("a") + F.col("b") - host).alias("guest")).withColumn("part", F.shiftright("guest", GUESTS_BITS)))
    bytes_of = packed.select(F.col("block"), "packed")
    guests = dealt.where("host != guest").join(bytes_of, F.col("guest") == F.col("block")).select("host", "part", "guest", "packed")
    own = dealt.where("host = guest").select("host", "part", "guest", F.lit(None).cast("binary").alias("packed"))
    hosts = dealt.select("host", "part").distinct().join(bytes_of, F.col("host") == F.col("block")).select("host", "part", F.lit(-1).cast("long").alias("guest"), "packed")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, nodes = None, None
        for batch in batches:
            for at, part, guest, packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if guest < 0:
                    host, nodes = (at, part), Nodes(np.frombuffer(packed, np.uint64)[:, None])
                    continue
                if host != (at, part):
                    raise ValueError("a guest block came before its host")
                other = nodes if packed is None else Nodes(np.frombuffer(packed, np.uint64)[:, None])
                names = nodes.rows[:, 0] if other is nodes else np.concatenate([nodes.rows[:, 0], other.rows[:, 0]])
                forest, shift = Forest(len(names)), 0 if other is nodes else len(nodes.rows)
                for x, y in links(nodes, other, most):
                    forest.join(x, y + shift)
                u, v = forest.edges(names)
                if len(u):
                    yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 1 << 16))
    routed = hosts.unionByName(guests).unionByName(own).repartition(parts, "host", "part")
    return routed.sortWithinPartitions("host", "part", "guest").mapInArrow(search, "u long, v long")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and its Gray rank of every row; a null text or one without a word has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            fp = np.array([simhash(shingle_hashes(t or "", shingle))[0] for t in texts], np.uint64)
            rank = gray_rank(fp) ^ np.uint64(1 << 63)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(fp.view(np.int64)), pa.array(rank.view(np.int64))], names=["doc_id", "fp", "rank"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long, rank long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Fingerprints at most `most` bits apart are linked, and so is all that links connect; component_id is the least doc_id
    there. A null text, and one without a word, has fingerprint zero and is linked like any other. Rows with the same
    doc_id, or the same row twice, each give a row. Columns besides doc_id and text aren't read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    prints = scratch.keep(fingerprints(docs, shingle))
    distinct = scratch.keep(prints.groupBy("fp", "rank").agg(F.min("doc_id").alias("least")))
    roots = connected_components(scratch.keep(near_links(distinct, most, scratch)), scratch)
    placed = scratch.keep(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = scratch.keep(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = scratch.keep(placed.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


# ---- a similarity bound ------------------------------------------------------------------------------------------------

LANES = 4
#: Fingerprints that share a pattern on average, least bits of a pattern, and the share of pairs at the bound that no table proposes.
SHARING = 512
LEAST_PATTERN = 10
MISS = 0.01
#: The largest share of differing bits of sets at a similarity of 0.8: four shingles and the same with a fifth, 3 of 16.
WORST_SHARE = 3 / 16
#: Fingerprints, and shingles and sets, that one task compares with each other; a larger group is searched in parts.
TILE = 4096
CHUNK = 2_000_000
CHUNK_SETS = 512


def allowed_bits(similarity: float, bits: int = 64 * LANES) -> int:
    """Differing bits up to which documents are candidates: what the shared part of two shingle sets leads to, and 3.5 standard deviations."""
    share = max(np.arccos(2 * similarity / (1 + similarity)) / np.pi, WORST_SHARE)
    return int(bits * share + 3.5 * np.sqrt(bits * share * (1 - share)))


def pattern_masks(n: int) -> list[np.ndarray]:
    """The bit positions of each table, by fixed shuffles, for n fingerprints.

    Patterns grow with the logarithm of n, so that as many fingerprints share one whatever the input, and tables are as many as
    MISS asks at that length.
    """
    width = max(LEAST_PATTERN, math.ceil(math.log2(max(n, 1) / SHARING)))
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - WORST_SHARE) ** width)))
    each = 64 * LANES // width
    order = [np.argsort(mixed(np.arange(64 * LANES, dtype=np.uint64), k + 1)) for k in range(-(-tables // each))]
    return [order[k // each][k % each * width : (k % each + 1) * width] for k in range(tables)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", shingle))


def wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text's hash, the shingle set's 128-bit digest, n (its size) and its fingerprint of LANES * 64 bits of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, texts = columns_of(batch, "doc_id", "text_hash", "text")
            sets = [shingle_set(t, shingle) for t in texts]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            wide = [np.array(simhash(s, LANES), "<u8").tobytes() for s in sets]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary())], names=["doc_id", "text_hash", "digest", "n", "fp"])

    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, digest binary, n long, fp binary")


Kernel = Callable[[np.ndarray, list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def grouped_links(rows: DataFrame, sizes: DataFrame, capacity: int, kernel: Kernel, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the nodes of each key just as all links inside it would.

    rows: key, node, weight (long), payload (binary); sizes: key, weight. kernel(nodes, payloads, labels): edges among them; equal
    labels are connected already. A key of more than `capacity` is dealt out by hash to several tasks, each of which links its own
    part. What these links connect needs no look any more: then only nodes outside the key's largest component meet all others,
    part by part. So a key that is one group of copies costs about its size, and a key of unlike nodes is searched whole.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    big = sizes.groupBy("key").agg(F.sum("weight").alias("total")).where(F.col("total") > capacity)
    big = scratch.keep(big.select("key", F.ceil(F.col("total") / capacity).cast("int").alias("chunks")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(own) > 1:
                nodes = np.fromiter(own, np.int64, len(own))
                u, v = kernel(nodes, [p for p, _ in own.values()], np.array([x for _, x in own.values()], np.int64))
                if len(u):
                    yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for *key, node, label, payload in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if key != at:
                    yield from found()
                    at, own = key, {}
                own[node] = payload, label
        yield from found()

    def searched(dealt: DataFrame, *key: str) -> DataFrame:
        dealt = dealt.select(*key, "node", "label", "payload").repartition(parts, *key).sortWithinPartitions(*key)
        return scratch.keep(dealt.mapInArrow(search, "u long, v long"))

    some = bool(big.take(1))
    dealt = rows.join(big, "key", "left").withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1)))) if some else rows.withColumn("chunk", F.lit(0))
    first = searched(dealt.withColumn("label", F.col("node")), "key", "chunk")
    if not some:
        return first
    roots = connected_components(first, scratch)
    labelled = scratch.keep(rows.join(big, "key").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    by_label = labelled.groupBy("key", "label").agg(F.sum("weight").alias("w"))
    left = by_label.groupBy("key").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.ceil((F.sum("w") - F.max("w")) / capacity).cast("int").alias("others"))
    left = scratch.keep(left.where("others > 0"))
    if not left.take(1):
        return first
    met = labelled.join(left, "key").withColumns({"own": F.pmod(F.xxhash64("node"), F.col("chunks")), "other": F.pmod(F.xxhash64("node", F.lit(1)), F.col("others"))})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    all_ = met.select("key", "node", "label", "payload", "own", upto("others").alias("other"))
    outside = met.where("label != main").select("key", "node", "label", "payload", upto("chunks").alias("own"), "other")
    second = searched(all_.unionByName(outside), "key", "own", "other")
    return first.unionByName(second)


def print_links(most: int) -> Kernel:
    """Kernel of fingerprints: at most `most` differing bits. Tiles in Gray order; one whose nodes are all connected is skipped."""

    def kernel(nodes: np.ndarray, prints: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
        _, of, counts = np.unique(labels, return_inverse=True, return_counts=True)
        order = np.lexsort((gray_rank(rows[:, 0]), of != counts.argmax()))
        rows, of = rows[order], of[order]
        forest = Forest(len(rows))
        first = np.full(len(counts), len(rows))
        np.minimum.at(first, of, np.arange(len(rows)))
        forest.join(first[of], np.arange(len(rows)))
        before = forest.label.copy()
        if len(rows) <= 2 * LEAF:
            near = np.zeros((len(rows), len(rows)), np.int32)
            for lane in range(rows.shape[1]):
                near += np.bitwise_count(rows[:, None, lane] ^ rows[None, :, lane])
            forest.join(*np.nonzero(np.triu(near <= most, 1)))
        else:
            tree = Nodes(rows)

            def settled(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                label = np.concatenate([forest.label, np.repeat(forest.label[-1:], len(tree.padded) - len(rows))]).reshape(-1, LEAF)
                low, high = label.min(1), label.max(1)
                return (low == high)[p] & (low == high)[q] & (low[p] == low[q])

            for x, y in links(tree, tree, most, settled):
                forest.join(x, y)
        new = np.nonzero(forest.label != before)[0]
        return nodes[order][new], nodes[order][forest.label[new]]

    return kernel


def pattern_links(distinct: DataFrame, n: int, most: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between nodes of distinct (n rows: node long, fp binary) that share a masked bit pattern and differ in at most `most` bits."""
    masks = pattern_masks(n)

    def emitted(with_rows: bool) -> Callable:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                    weight = pa.array(np.ones(part.num_rows, np.int64))
                    for k, own in enumerate(masks):
                        key = pa.array((k << len(own)) + bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64)))
                        if with_rows:
                            yield pa.record_batch([key, part.column(0), weight, part.column(1)], names=["key", "node", "weight", "payload"])
                        else:
                            yield pa.record_batch([key, weight], names=["key", "weight"])

        return emit

    prints = distinct.select("node", "fp")
    rows = map_texts(prints, emitted(True), "key long, node long, weight long, payload binary")
    return grouped_links(rows, map_texts(prints, emitted(False), "key long, weight long"), TILE, print_links(most), scratch)


def similar_sets(sets: list[np.ndarray], similarity: float, labels: list[int] | None = None) -> list[int]:
    """For each sorted set its group's label: sets that share `similarity` of their union or more are joined, and all they connect.

    Exact: similar sets have one of their rarest shingles in common, as many as they may miss and one more. An index of these
    gives the pairs to compare; pairs in one group already are passed over, so a group of copies costs about its size. labels:
    each set's least index among those that are one group to begin with.
    """
    up = list(labels) if labels is not None else list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def similar(i: int, j: int) -> bool:
        n, m = len(sets[i]), len(sets[j])
        if min(n, m) < similarity * max(n, m) - 1e-9:
            return False
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both >= similarity * (n + m - both) - 1e-9

    names, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    index: dict[int, list] = {}  # shingle: the sets that have it among their rarest, and how many at the front are in one group
    for i, own in enumerate(sets):
        rarest = own[np.argsort(counts[np.searchsorted(names, own)], kind="stable")[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]]
        tried = set()
        for shingle in rarest.tolist():
            there, alike = entry = index.setdefault(shingle, [[], 0])
            while alike < len(there) and root(there[alike]) == root(there[0]):
                alike += 1
            entry[1] = alike
            k = 0
            while k < len(there):
                j = there[k]
                if root(i) != root(j):
                    if j not in tried and similar(i, j):
                        up[max(root(i), root(j))] = min(root(i), root(j))
                    tried.add(j)
                k = alike if k < alike and root(i) == root(j) else k + 1
            there.append(i)
    return [root(i) for i in range(len(sets))]


def set_links(similarity: float) -> Kernel:
    """Kernel of packed shingle sets."""

    def kernel(nodes: np.ndarray, packed: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        before = first[of]
        after = np.array(similar_sets([np.frombuffer(p, "<u8") for p in packed], similarity, before.tolist()))
        new = np.nonzero(after != before)[0]
        return nodes[new], nodes[after[new]]

    return kernel


def perhaps_in(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows less most of those whose text_hash isn't in members: by a bitmap of 2**23 places (1 MB), whatever the input."""
    place = F.pmod("text_hash", F.lit(1 << 23))
    bitmap = members.groupBy(F.shiftright(place, 15).alias("_qm_part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("_qm_bits"))
    placed = rows.withColumn("_qm_part", F.shiftright(place, 15)).withColumn("_qm_bit", place.bitwiseAND(32767).cast("int"))
    is_set = F.expr("(cast(conv(hex(substring(_qm_bits, _qm_bit div 8 + 1, 1)), 16, 10) as int) >> (_qm_bit % 8)) & 1") == 1
    return placed.join(F.broadcast(bitmap), "_qm_part").where(is_set).select(*rows.columns)


def verified_links(docs: DataFrame, members: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between members of one proposed group that connect them just as all pairs of similar shingle sets would.

    members: node, n (its shingles), root (its group), first (doc_id and text_hash of a row that has the set).
    """
    weight = F.greatest("n", F.lit(CHUNK // CHUNK_SETS)).cast("long")
    texts = perhaps_in(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), members.select(F.col("first.text_hash").alias("text_hash")))
    wanted = members.select(F.col("root").alias("key"), "node", weight.alias("weight"), F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    met = wanted.join(texts, (wanted["first_hash"] == texts["text_hash"]) & wanted["first_id"].eqNullSafe(texts["doc_id"])).select("key", "node", "weight", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = columns_of(batch, "text")[0]
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array([shingle_set(t, shingle).astype("<u8").tobytes() for t in texts], pa.binary())], names=["key", "node", "weight", "payload"])

    rows = scratch.keep(map_texts(met, pack, "key long, node long, weight long, payload binary"))
    sizes = members.select(F.col("root").alias("key"), weight.alias("weight"))
    return grouped_links(rows, sizes, CHUNK, set_links(similarity), scratch)


def documents_kept(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs less near copies: of each group of similar documents, the row with the least doc_id stays.

    Similar: five-word shingle sets that share `similarity` of their union or more. Wide fingerprints propose groups, the sets
    themselves decide. A row that repeats a kept one in doc_id and text goes too. Texts that are null or have no word are
    alike, so one of them stays. Columns of docs stay as they are, whatever their names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dup-wide")
    prints = scratch.keep(wide_prints(docs, shingle))
    distinct = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    distinct = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()).drop("digest"))
    repeated = scratch.keep(prints.groupBy("doc_id", "text_hash").count().where("count > 1"))
    scratch.drop(prints)
    fewest = int(np.ceil(similarity / (1 - similarity) - 1e-9))  # a smaller set is similar to none but its like
    tried = distinct.where(F.col("n") >= fewest)
    proposed = connected_components(scratch.keep(pattern_links(tried, tried.count(), allowed_bits(similarity), scratch)), scratch)
    grouped = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root").distinct())
    members = scratch.keep(grouped.join(distinct.select("node", "n", "first"), "node"))
    roots = connected_components(scratch.keep(verified_links(docs, members, shingle, similarity, scratch)), scratch)
    placed = distinct.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    key, text_hash, own, own_hash = (free_name(n, docs.columns) for n in ("kept_id", "kept_hash", "own_id", "own_hash"))
    kept = scratch.keep(placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(key), F.col("first.text_hash").alias(text_hash)))
    hashed = docs.withColumns({own: F.col("doc_id"), own_hash: F.xxhash64("text")})
    stay = hashed.join(kept, F.col(own).eqNullSafe(F.col(key)) & (F.col(own_hash) == F.col(text_hash)), "left_semi")
    if repeated.take(1):
        stay = stay.dropDuplicates([own, own_hash])
    return stay.select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group of near copies stays."""
    return documents_kept(docs)
