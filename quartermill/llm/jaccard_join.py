"""N-gram Jaccard join (operator 13): prefixes of single tokens where they are rare, of token combinations where they are frequent.

A token is a five-word shingle's hash. Sets that are similar enough may miss `spare` tokens of each other at most, so that any
spare + 1 of a set's tokens, taken in an order that holds for all sets, share one with every similar set. The order is: rare
tokens by hash, then frequent ones by hash. What is frequent is found by counting, not guessed: a set's window is its first
spare + 1 hashes to begin with, and grows where frequent tokens leave fewer rare ones in it, until no window grows any more.
A prefix that rare tokens fill is indexed by its tokens. One that they don't fill goes on into the frequent tokens, which are dealt
by hash into classes: a class of c tokens there costs c - 1 misses to lose all its pairs, so the prefix extends until rare tokens
and the classes' c - 1 exceed `spare`, and is indexed by the pairs within each class besides. A passage that a third of all
documents quote thus makes no pair of them a candidate unless they consist of such passages.

Groups of up to FEW sets under one index key give pairs, with the number of prefix tokens that they share and the places of
the last; what may be alike behind it bounds their overlap, and few pairs are left. Bitmaps of the sets, a fifth of a text's size,
rule out most of these for certain (a bit that one alone has is a token that the other lacks). Whole sets decide the rest exactly: first each
set with the least that it is paired with, then pairs that these links leave apart. Larger groups are near copies by the
thousand; they are dealt out to tasks that pass over what is linked already (near_dup.grouped_links).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, columns_of, map_texts, table
from quartermill.llm.components import connected_components
from quartermill.llm.near_dup import perhaps_in, shingle_set, verified_links

SHINGLE = 5
#: Similarity in per cent.
BOUND = 80
#: A token of more sets is frequent, and a group of more sets is dealt out.
FEW = 24
#: Frequent tokens of a set that share a class, on average over a whole set of its size class.
PER_CLASS = 4


def spare_of(n: int, bound: int = BOUND) -> int:
    """Tokens that a set of n may have and a similar one lack."""
    return n - -(-bound * n // 100)


def fewest(bound: int = BOUND) -> int:
    """Sets of fewer tokens are similar to none but their like."""
    return -(-bound // (100 - bound)) if bound < 100 else 1 << 62


def reserve_of(n: int, bound: int = BOUND) -> int:
    """First hashes that are kept of a set of n: the prefix, and some in place of frequent ones."""
    prefix = spare_of(n, bound) + 1
    return min(n, prefix + prefix // 6 + 8)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    lengths = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64()))


def set_rows(docs: DataFrame, shingle: int, bound: int) -> DataFrame:
    """doc_id, text_hash, digest (of the set), n, head (its first hashes; none for sets too small to have unlike partners) of every row."""
    import xxhash

    least = fewest(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, texts = columns_of(batch, "doc_id", "text_hash", "text")
            digests, sizes, parts = [], [], []
            for text in texts:
                own = shingle_set(text, shingle).astype("<u8")
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                parts.append(own[: reserve_of(len(own), bound) if len(own) >= least else 0].copy())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists(parts)], names=["doc_id", "text_hash", "digest", "n", "head"])

    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, digest binary, n long, head array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda texts: texts) -> DataFrame:
    """node, n, text of nodes: node, n, first (doc_id and text_hash of a row that has the set). Rows may repeat.

    made: puts other columns in text's place, ahead of the join.
    """
    texts = perhaps_in(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), nodes.select(F.col("first.text_hash").alias("text_hash")))
    wanted = nodes.select("node", "n", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    texts = made(texts)
    return wanted.join(texts, (wanted["first_hash"] == texts["text_hash"]) & wanted["first_id"].eqNullSafe(texts["doc_id"])).drop("first_id", "first_hash", "doc_id", "text_hash")


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, n, tokens (all, by hash) of nodes as in texts_of. Rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), lists([shingle_set(t, shingle) for t in columns_of(batch, "text")[0]])], names=["node", "n", "tokens"])

    return map_texts(texts_of(docs, nodes), run, "node long, n long, tokens array<long>")


def packed_texts(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, bits (sketch), packed (its text, compressed: a third and less of its hashes) of nodes as in texts_of. Rows may repeat.

    Texts are packed where they are read, and travel so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys, hashes, texts = columns_of(batch, "doc_id", "text_hash", "text")
            packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array([sketch(shingle_set(t, shingle)) for t in texts], pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "bits", "packed"])

    return texts_of(docs, nodes, lambda texts: map_texts(texts, run, "doc_id long, text_hash long, bits binary, packed binary")).select("node", "bits", "packed")


def sketch(tokens: np.ndarray) -> bytes:
    """The number of tokens (8 bytes), then a bitmap of 4 to 8 bits a token in which each sets the bit of its low digits."""
    bits = np.zeros(1 << max(6, (4 * len(tokens) - 1).bit_length()), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return len(tokens).to_bytes(8, "little") + np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def perhaps_similar(u: bytes, v: bytes, bound: int) -> bool:
    """Whether sets with these sketches may be similar. A bit of one alone is a token that the other lacks, so no similar pair is lost."""
    n_u, n_v = (int.from_bytes(x[:8], "little") for x in (u, v))
    of_u, of_v = (np.frombuffer(x, np.uint8, offset=8) for x in (u, v))
    size = min(len(of_u), len(of_v))
    of_u, of_v = folded(of_u, size), folded(of_v, size)
    both = -(-bound * (n_u + n_v) // (100 + bound))
    return int(np.bitwise_count(of_u & ~of_v).sum()) <= n_u - both and int(np.bitwise_count(of_v & ~of_u).sum()) <= n_v - both


# ---- frequent tokens -------------------------------------------------------------------------------------------------------


def prefix_length(n: str, bound: int) -> Column:
    """spare_of + 1 of a column."""
    return (F.col(n) - F.ceil(F.col(n) * bound / 100) + 1).cast("int")


def marked(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """rows with _qm_in, which is false for most whose key isn't among members' (one column) and true for all others: by 2**18 words of 64 bits, whatever the input."""
    # numbers of rows are alike in their low digits
    place = F.xxhash64(key).bitwiseAND((1 << 24) - 1)
    word, one = F.shiftright(place, 6).alias("_qm_word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = members.toDF(key).select(word, one.alias("_qm_one")).groupBy("_qm_word").agg(F.bit_or("_qm_one").alias("_qm_bits"))
    is_set = F.coalesce(F.col("_qm_bits").bitwiseAND(one) != 0, F.lit(False))
    return rows.withColumn("_qm_word", word).join(F.broadcast(words), "_qm_word", "left").select(*rows.columns, is_set.alias("_qm_in"))


def possibly(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """rows less most of those whose key isn't among members'."""
    return marked(rows, key, members).where("_qm_in").drop("_qm_in")


class Windows:
    """The first hashes of every set that are looked at, and which tokens are frequent in them.

    A token is frequent if more than FEW windows have it. base: the windows to begin with, of spare + 1 hashes; added: node, token
    of what windows have grown by; hits: node, token where a window has a frequent one; whole: the sets whose window is all they
    have. A window grows to the head that is kept of every set and then to the whole set.
    """

    def __init__(self, with_heads: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int, bound: int, scratch: Scratch):
        self.docs, self.shingle, self.bound, self.scratch = docs, shingle, bound, scratch
        self.distinct = distinct
        self.sets = with_heads.where(F.size("head") > 0).select("node", "n", "head")
        self.base = self.sets.select("node", F.explode(F.slice("head", F.lit(1), prefix_length("n", bound))).alias("token"))
        empty = distinct.sparkSession.createDataFrame
        self.counts = scratch.keep(self.base.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"))
        self.frequent = scratch.keep(self.counts.where(F.col("sets") > FEW).select("token"))
        self.added, self.whole, self.wide = scratch.keep(empty([], "node long, token long")), empty([], "node long, n long, tokens array<long>"), empty([], "node long")
        self.any, self.grown, self.by_head = bool(self.frequent.take(1)), False, None
        if self.any:
            self.hits = scratch.keep(self._having(self.base, self.frequent))
            while self._grown():
                pass

    @staticmethod
    def _having(rows: DataFrame, tokens: DataFrame) -> DataFrame:
        # tokens are distinct; a semi join would be moved ahead of the bitmap
        return possibly(rows, "token", tokens).join(tokens, "token").select("node", "token")

    def _grown(self) -> bool:
        """Lets windows grow that have too few rare tokens; whether any did."""
        keep = self.scratch.keep
        found = self.hits.groupBy("node").agg(F.count("*").alias("found"))
        full = self.whole.select("node").distinct()
        short = found.join(full, "node", "left_anti").join(self.distinct.select("node", "n"), "node").join(self.wide.withColumn("is_wide", F.lit(True)), "node", "left")
        length = prefix_length("n", self.bound)
        kept = F.least(F.col("n"), length + F.floor(length / 6) + 8).cast("int")  # reserve_of
        window = F.when(F.col("is_wide"), kept).otherwise(length)
        short = keep(short.where((window < F.col("n")) & (window - F.col("found") < length)).select("node", "n", kept.alias("kept"), F.coalesce("is_wide", F.lit(False)).alias("is_wide")))
        if not short.take(1):
            return False
        whole = keep(whole_sets(self.docs, short.where("is_wide").join(self.distinct.select("node", "first"), "node").select("node", "n", "first"), self.shingle).dropDuplicates(["node"]))
        behind = whole.join(short.select("node", "kept"), "node").select("node", F.explode(F.slice("tokens", F.col("kept") + 1, F.greatest(F.size("tokens") - F.col("kept"), F.lit(0)))).alias("token"))
        wider = short.where("NOT is_wide").select("node")
        # of the head only what the window grows by travels
        beyond = possibly(self.sets, "node", wider).select("node", F.slice("head", length + 1, F.size("head") - length).alias("tokens"))
        within = beyond.join(wider, "node").select("node", F.explode("tokens").alias("token"))
        new = keep(within.unionByName(behind))
        self.whole, self.wide = keep(self.whole.unionByName(whole)), keep(self.wide.unionByName(short.where("NOT is_wide").select("node")))
        before = self.added
        self.added = before.unionByName(new)
        # a token of one window at most to begin with isn't in counts
        # only what is new can make a token frequent
        counted, counts = new, self.counts
        if self.grown:
            counted, counts = (possibly(rows, "token", new.select("token")) for rows in (before, counts))
            counted = counted.unionByName(new)
        self.grown = True
        more = counted.groupBy("token").agg(F.count("*").alias("more")).join(counts, "token", "left").where(F.col("more") + F.coalesce("sets", F.lit(1)) > FEW)
        fresh = keep(more.select("token").join(self.frequent, "token", "left_anti"))
        known = self._having(new, self.frequent)
        self.frequent = keep(self.frequent.unionByName(fresh))
        hits = self.hits.unionByName(known)
        if fresh.take(1):
            hits = hits.unionByName(self._having(self.base.unionByName(before).unionByName(new), fresh))
        self.hits = keep(hits)
        return True

    def index(self) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """key, node, place (from 1) of all prefixes' rare tokens but most that one window alone has; key, node of the pairs of
        frequent tokens, if any token is frequent; and node, n, ending, taken: where a set's prefix ends among the rare tokens, and
        how many of them it takes. A prefix that goes into frequent tokens ends behind all rare ones.
        """
        length, signed = prefix_length("n", self.bound), lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  in the order of unsigned hashes
        # frequent tokens are among these, but in no prefix; a token that one prefix alone has gives no pair
        shared = self.counts.select("token").unionByName(self.added.select("token"))
        taken, pairs = F.slice("head", F.lit(1), length), None
        if not self.any:
            prefixes = self.sets.select("node", "n", taken.alias("prefix"))
        else:
            often = self.scratch.keep(self.hits.groupBy("node").agg(F.collect_set("token").alias("often")))  # a set's own tokens
            # of a set with frequent tokens, unless its window is all it has: the rare ones of its head
            own = F.when(F.col("often").isNull(), taken).when(F.size("head") < F.col("n"), F.slice(F.filter("head", lambda t: ~F.array_contains("often", t)), F.lit(1), length))
            # sets without frequent tokens stay where they are; the others' windows alone can be all they have
            sets = marked(self.sets, "node", often.select("node"))
            met = sets.where("_qm_in").join(often, "node", "left").join(self.whole.select("node", F.lit(True).alias("by_set")), "node", "left")
            by_head = met.select("node", "n", F.when(F.col("by_set").isNull(), own).alias("prefix"))
            by_head = self.by_head = self.scratch.keep(by_head.unionByName(sets.where("NOT _qm_in").select("node", "n", taken.alias("prefix"))))
            small = self.sets.where(F.size("head") == F.col("n")).select("node", "n", F.col("head").alias("tokens"))
            by_set = small.join(often, "node").unionByName(self.whole.join(often, "node"))
            bound = self.bound

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    nodes, sizes, tokens, of = (batch.column(k).to_pylist() for k in range(4))
                    made = [combined(np.array(t, np.int64).view(np.uint64), np.array(o, np.int64).view(np.uint64), n, bound) for n, t, o in zip(sizes, tokens, of)]
                    yield pa.record_batch([batch.column(0), batch.column(1), lists([m[0] for m in made]), lists([m[1] for m in made])], names=["node", "n", "prefix", "pairs"])

            mixed = self.scratch.keep(map_texts(by_set, run, "node long, n long, prefix array<long>, pairs array<long>"))
            prefixes = by_head.where("prefix IS NOT NULL").unionByName(mixed.select("node", "n", "prefix"))
            pairs = mixed.select(F.explode("pairs").alias("key"), "node")
        singles = possibly(prefixes.select("node", F.posexplode("prefix").alias("place", "token")), "token", shared)
        filled = F.size("prefix") == length
        ending = F.when(filled, signed(F.element_at("prefix", length))).otherwise(F.lit((1 << 63) - 1))
        return singles.select(F.col("token").alias("key"), "node", F.col("place") + 1), pairs, prefixes.select("node", "n", ending.alias("ending"), F.when(filled, length).otherwise(0).alias("taken"))


    def drop(self) -> None:
        """Deletes the largest tables; for when the index is stored."""
        for df in (self.counts, self.by_head):
            self.scratch.drop(df)


def class_number(n: int) -> int:
    """Classes of the frequent tokens in sets of n, alike for all n of one power of two."""
    return max(1, (1 << max(0, n.bit_length() - 1)) // PER_CLASS)


def size_classes(n: int, bound: int) -> list[int]:
    """The set's own class of sizes and, where a similar larger set may lie in the next, that too."""
    own = n.bit_length()
    return [own, own + 1] if (n * 100 // bound).bit_length() > own else [own]


def combined(tokens: np.ndarray, frequent: np.ndarray, n: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The rare tokens of a set's prefix, and the keys of its pairs of frequent ones; none where the rare ones fill the prefix.

    tokens: a window of the set, or all of it where rare ones don't fill the prefix, sorted as unsigned; frequent: those of them
    that are; n: the set's size. All of a set's tokens exceed its classes by more than it may miss, so that the prefix always
    ends within the set.
    """
    spare = spare_of(n, bound)
    is_frequent = np.isin(tokens, frequent)
    singles, often = tokens[~is_frequent][: spare + 1], tokens[is_frequent]
    if len(singles) > spare:
        return singles, np.zeros(0, np.uint64)
    keys = []
    for size in size_classes(n, bound):
        classes = class_number(1 << (size - 1))
        of = (often >> np.uint64(17)) % np.uint64(classes)
        # the k-th token adds to the misses unless it is the first of its class
        _, first = np.unique(of, return_index=True)
        adds = np.ones(len(often), np.int64)
        adds[first] = 0
        enough = np.searchsorted(np.cumsum(adds), spare + 1 - len(singles))
        head, of = often[: enough + 1], of[: enough + 1]
        order = np.argsort(of, kind="stable")
        head, of = head[order], of[order]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, b in zip(begin, np.r_[begin[1:], len(of)]):
            i, j = np.triu_indices(b - a, 1)
            own = head[a:b]
            keys.append((own[i] * np.uint64(0x9E3779B97F4A7C15) ^ own[j]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size))
    return singles, np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


# ---- pairs -----------------------------------------------------------------------------------------------------------------


def candidates(grouped: DataFrame, info: DataFrame, bound: int) -> DataFrame:
    """u, v (u < v) of sets under one key that may be similar by what their prefixes share.

    grouped: key, node, place; FEW to a key at most. Rare tokens that both have stand in both prefixes up to the end of the one
    that ends first, and behind the last shared one none is shared before that end.
    """
    a, b = (grouped.select("key", F.col("node").alias(x), F.col("place").alias(f"{x}_place")) for x in "uv")
    met = a.join(b, "key").where("u < v").groupBy("u", "v").agg(F.sum((F.col("u_place") > 0).cast("int")).alias("shared"), F.max("u_place").alias("u_place"), F.max("v_place").alias("v_place"))
    for x in "uv":
        met = met.join(info.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("ending").alias(f"{x}_ending"), F.col("taken").alias(f"{x}_taken")), x)
    behind = F.when(F.col("u_ending") <= F.col("v_ending"), F.least(F.col("u_n") - F.col("u_taken"), F.col("v_n") - F.col("v_place"))).otherwise(F.least(F.col("u_n") - F.col("u_place"), F.col("v_n") - F.col("v_taken")))
    return met.where((100 + bound) * (F.col("shared") + behind) >= bound * (F.col("u_n") + F.col("v_n"))).where(100 * F.least("u_n", "v_n") >= bound * F.greatest("u_n", "v_n")).select("u", "v")


def decided_pairs(pairs: DataFrame, nodes: DataFrame, load: Callable[[bytes], Any], similar: Callable[[Any, Any], bool], scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that are similar by what load makes of their nodes (node, value). A value travels once a pair, u's once."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if v is None:
                    at, own = u, load(value)
                    continue
                if u != at:
                    raise ValueError("a set came before the one to compare it with")
                if similar(own, load(value)):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    heads = pairs.select("u").distinct().join(nodes.toDF("u", "value"), "u").select("u", F.lit(None).cast("long").alias("v"), "value")
    tails = pairs.join(nodes.toDF("v", "value"), "v").select("u", "v", "value")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = heads.unionByName(tails).repartition(parts, "u").sortWithinPartitions("u", F.col("v").asc_nulls_first())
    return scratch.keep(map_texts(routed, verify, "u long, v long"))


def verified_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, bound: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets share `bound` per cent of their union or more, by their texts (packed_texts)."""

    def load(packed: bytes) -> np.ndarray:
        import zstandard

        return shingle_set(zstandard.decompress(packed).decode("utf-8", "surrogatepass"), shingle)

    def similar(u: np.ndarray, v: np.ndarray) -> bool:
        both = len(np.intersect1d(u, v, assume_unique=True))
        return 100 * both >= bound * (len(u) + len(v) - both)

    return decided_pairs(pairs, texts.select("node", "packed"), load, similar, scratch)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, bound: int = BOUND) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A text's set holds its distinct word shingles; with fewer words the whole sequence is its one member; a null text and one
    without a word have none, and are linked with nothing (component_id is their doc_id). Sets that share `bound` per cent of
    their union or more are linked, and so is all that links connect; component_id is the least doc_id there. Shingles are
    told apart by 64-bit hash. Rows with the same doc_id, or the same row twice, each give a row. A null doc_id is never a
    component's least one unless it has no other. Columns besides doc_id and text aren't read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    headed = scratch.keep(set_rows(docs, shingle, bound))
    rows = scratch.keep(headed.select("doc_id", "n", "digest"))
    with_heads = scratch.keep(distinct_sets(headed, scratch).withColumn("node", F.monotonically_increasing_id()))
    scratch.drop(headed)
    distinct = scratch.keep(with_heads.drop("head"))
    edges = links_of(with_heads, distinct, docs, shingle, bound, scratch)
    roots = connected_components(edges, scratch)
    placed = scratch.keep(distinct.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(placed.join(least, "root").select("digest", "component_id"))
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return own.join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct_sets(headed: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, least (doc_id), first (doc_id and text_hash), n, head of every set of set_rows that has a token. Heads of sets without copies don't travel."""
    sets = headed.where("n > 0")
    repeated = scratch.keep(sets.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest"))
    sets, first = marked(sets, "digest", repeated), F.struct("doc_id", "text_hash")
    copies = sets.where("_qm_in").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(first).alias("first"), F.first("n").alias("n"), F.first("head").alias("head"))
    return copies.unionByName(sets.where("NOT _qm_in").select("digest", F.col("doc_id").alias("least"), first.alias("first"), "n", "head"))


def links_of(with_heads: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int, bound: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the distinct sets just as all links would. with_heads goes when the index stands."""
    windows = Windows(with_heads, distinct, docs, shingle, bound, scratch)
    singles, combos, info = windows.index()
    singles, large = scratch.keep(singles.toDF("key", "node", "place")), None
    grouped = singles
    info = scratch.keep(info)
    windows.drop()
    scratch.drop(with_heads)
    if combos is not None:
        sizes = scratch.keep(combos.groupBy("key").agg(F.count("*").alias("sets"), F.min("node").alias("leader")).where("sets > 1"))
        combos = scratch.keep(combos.join(sizes, "key"))
        grouped = grouped.unionByName(combos.where(F.col("sets") <= FEW).select("key", "node", F.lit(0).alias("place")))
        large = scratch.keep(combos.where((F.col("sets") > FEW) & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())
    pairs = scratch.keep(candidates(grouped, info, bound))
    scratch.drop(singles)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = scratch.keep(packed_texts(docs, nodes.join(distinct, "node").select("node", "n", "first"), shingle))
    pairs = decided_pairs(pairs, texts.select("node", "bits"), bytes, lambda u, v: perhaps_similar(u, v, bound), scratch)
    edges = verified_pairs(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), texts, shingle, bound, scratch)
    roots = connected_components(edges, scratch)
    for x in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    apart = scratch.keep(pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))
    edges = edges.unionByName(verified_pairs(apart, texts, shingle, bound, scratch))
    if large is not None and large.take(1):
        groups = connected_components(large, scratch)
        groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
        members = scratch.keep(groups.join(distinct.select("node", "n", "first"), "node"))
        edges = edges.unionByName(verified_links(docs, members, shingle, bound / 100, scratch))
    return scratch.keep(edges)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by their shingle sets' similarity."""
    return jaccard_components(table(spark, sf_dir, "documents"))
