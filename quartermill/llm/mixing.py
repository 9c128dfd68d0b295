"""Mixing sources to target weights (operator 1): a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a digest of doc_id and laid end to end; the stream is cut into blocks of BLOCK words.
Slot i of the mix has the point frac(i * golden ratio), in 32-bit integers; mapped through the sources' cumulative weights it
names a source, and the slot's rank among that source's slots names the block: block rank modulo the number of blocks. What
the points leave over at the end, a few slots a source, is appended, so every source gets its words exactly. scheduled() gives the
mix itself, block after block; what a document gives to it is summed from that.

Hot sources are spread: offsets come from sums of BUCKETS shuffle buckets, ranks from counts of slot chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, free_name, table

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 256
BUCKETS_BITS = 12
#: Fixed value: 2**32 over the golden ratio, odd.
GOLDEN = 2654435769
CELL_BITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def digest(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of doc_id, or of the text where there is none: the shuffle order."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def in_order(df: DataFrame, scratch: Scratch, *order: Column) -> tuple[DataFrame, DataFrame]:
    """df sorted over partitions, with pid and pos inside; and by pid the rows in earlier partitions (`rows_before`)."""
    placed = scratch.keep(df.orderBy(*order).withColumns({"pid": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    return placed, _before(placed.groupBy("pid").agg(F.count("*").alias("n")), "n", "rows_before")


def _before(sums: DataFrame, value: str, name: str) -> DataFrame:
    """Sums of earlier pids; a row for each partition, so their number is bounded by the number of partitions."""
    total, rows = 0, []
    for pid, n in sorted((r["pid"], r[value]) for r in sums.collect()):
        rows.append((pid, total))
        total += n
    return sums.sparkSession.createDataFrame(rows, f"pid int, {name} long")


def fill_level(sources: DataFrame, share: float, floor: float, cap: float) -> float:
    """The level x at which the sum of x * weight, held between floor and cap times the source's size, is share of all sizes."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    if not total:
        return 0.0
    wanted, level, below, above, seen = share * total, None, 0.0, math.inf, None
    for _ in range(200):
        x = F.lit(level) * F.col("w") if level is not None else F.lit(0.0)
        low = (x <= floor * F.col("size")) if level is not None and floor else (F.col("size") == 0)
        high = ~low & (x >= cap * F.col("size")) if level is not None else F.lit(False)
        kind = F.when(low, 0).when(high, 2).otherwise(1)
        got = sources.groupBy(kind.alias("kind")).agg(F.sum("size").alias("size"), F.sum("w").alias("w"), F.count("*").alias("n")).collect()
        by = {r["kind"]: r for r in got}
        part = lambda k, c: by[k][c] if k in by else 0  # noqa: B023, E731
        state = (part(0, "n"), part(1, "n"), part(2, "n"))
        if state == seen or not part(1, "w"):
            break
        seen = state
        if level is not None:
            reached = floor * part(0, "size") + cap * part(2, "size") + level * part(1, "w")
            below, above = (level, above) if reached < wanted else (below, level)
        following = (wanted - floor * part(0, "size") - cap * part(2, "size")) / part(1, "w")
        level = following if below <= following <= above or math.isinf(above) else (below + above) / 2
    return level or 0.0


def plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, floor: float, cap: float) -> DataFrame:
    """A row for each source: no_source, src, sid (place by code point, null last), source_size, target, goal, n_blocks, quota, lo, hi (its part of 2**32)."""
    sums = rows.groupBy("no_source", "src").agg(F.sum("size").alias("size"))
    placed, before = in_order(sums, scratch, F.col("no_source"), F.col("src"))
    sid = F.col("rows_before") + F.col("pos")
    weight = F.element_at(F.array(*map(F.lit, weights)), (sid % len(weights) + 1).cast("int"))
    sources = scratch.keep(placed.join(F.broadcast(before), "pid").select("pid", "pos", "no_source", "src", "size", sid.alias("sid"), weight.alias("w")))
    level = fill_level(sources, share, floor, cap)
    target = F.greatest(F.least(F.lit(level) * F.col("w"), F.lit(float(cap)) * F.col("size")), F.lit(float(floor)) * F.col("size"))
    goal, size = F.col("goal"), F.col("size")
    planned = sources.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("n_blocks", F.ceil(size / BLOCK).cast("long"))
    full = F.when(size > 0, F.expr("goal div size")).otherwise(0)
    planned = planned.withColumn("quota", F.when(size > 0, full * F.col("n_blocks") + F.ceil((goal - full * size) / BLOCK)).otherwise(0).cast("long"))
    planned = scratch.keep(planned)
    quotas = _before(planned.groupBy("pid").agg(F.sum("quota").alias("n")), "n", "quota_before")
    slots = planned.agg(F.sum("quota")).first()[0] or 0
    inside = F.sum("quota").over(Window.partitionBy("pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = lambda c: F.floor(c / F.lit(float(max(slots, 1))) * float(1 << 32)).cast("long")
    end = F.col("quota_before") + inside
    return scratch.keep(planned.join(F.broadcast(quotas), "pid").withColumns({"lo": cut(end - F.col("quota")), "hi": cut(end)}).withColumnRenamed("size", "source_size").withColumn("slots", F.lit(slots).cast("long")))


def schedule(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each slot: slot, sid, block, words it takes from the block's start."""
    spark = sources.sparkSession
    first = sources.select("slots").first()
    slots = first[0] if first else 0
    own = sources.where("quota > 0").select("sid", "source_size", "goal", "n_blocks", "quota", "lo", "hi")
    cells = own.where("hi > lo").select("sid", "quota", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    low = F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))
    point = (F.shiftleft((F.shiftright(low, 16) * GOLDEN).bitwiseAND(F.lit(0xFFFF)), 16) + low.bitwiseAND(F.lit(0xFFFF)) * GOLDEN).bitwiseAND(F.lit(0xFFFFFFFF))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.shiftright("u", CELL_BITS))
    chunk = max(4096, math.isqrt(slots))
    hits = scratch.keep(points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.expr(f"slot div {chunk}").alias("chunk")))
    counts = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.keep(counts.withColumn("earlier", earlier))
    ranked = hits.join(counts.select("sid", "chunk", "earlier"), ["sid", "chunk"]).select("slot", "sid", (F.col("earlier") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).alias("rank"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    missing = own.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    tail = missing.select("sid", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    taken = ranked.unionByName(tail).join(own, "sid").where("rank < quota")
    block = F.col("rank") % F.col("n_blocks")
    start = F.expr("rank div n_blocks") * F.col("source_size") + block * BLOCK
    return taken.select("slot", "sid", block.alias("block"), F.least(F.lit(BLOCK), F.col("source_size") - block * BLOCK, F.col("goal") - start).alias("words"))


ROW = ["doc_id", "no_source", "src", "size", "text_hash", "source_size", "target"]


def _held(docs: DataFrame, weights: tuple[int, ...], share: float, floor: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Each row's place in its source's stream (ROW, sid, at), and its pieces by slot (ROW, sid, at, slot, first, words); without a slot words is 0."""
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.col("source")
    rows = docs.select("doc_id", source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("src"), word_count(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text")).alias("h"), F.xxhash64("text").alias("text_hash"))
    rows = scratch.keep(rows.withColumn("bucket", F.shiftright("h", 60 - BUCKETS_BITS).cast("int")))
    sources = plan(rows, scratch, weights, share, floor, cap)
    slots = schedule(sources, scratch)
    key = ["no_source", "src", "bucket"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no_source", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = scratch.keep(sums.withColumn("before", before).join(sources.select("no_source", "src", "sid", "source_size", "target"), ["no_source", "src"]).drop("n"))
    running = F.sum("size").over(Window.partitionBy(*key).orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = scratch.keep(rows.join(buckets, key).withColumn("at", F.col("before") + running - F.col("size")).select(*ROW, "sid", "at"))
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}"))))
    begin = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    met = pieces.withColumns({"begin": begin, "end": end}).join(slots.withColumnRenamed("words", "upto"), ["sid", "block"], "left")
    words = F.greatest(F.least("end", F.coalesce("upto", F.lit(0))) - F.col("begin"), F.lit(0))
    return laid, met.select(*ROW, "sid", "at", "slot", F.greatest(F.col("block") * BLOCK - F.col("at"), F.lit(0)).alias("first"), words.alias("words"))


def scheduled(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, floor: float = 0.0, cap: float = 2.0) -> DataFrame:
    """The mix: slot, source, doc_id, text_hash, first (word of the document, from 0) and words of each piece; sorted by slot and place it is the corpus.

    Slots are blocks of BLOCK words of one source, a source's last one shorter; a block that spans documents has a row for each.
    """
    held = _held(docs, weights, share, floor, cap)[1]
    return held.where("slot IS NOT NULL AND words > 0").select("slot", "at", F.when(~F.col("no_source"), F.col("src")).alias("source"), "doc_id", "text_hash", "first", "words")


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, floor: float, cap: float) -> DataFrame:
    """ROW and taken of every row."""
    laid, held = _held(docs, weights, share, floor, cap)
    whole = held.groupBy(*ROW, "sid", "at").agg(F.sum("words").alias("taken")).select(*ROW, "taken")
    return whole.unionByName(laid.where("size = 0").select(*ROW, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, floor: float = 0.0, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    size: words of the text (null: 0). Sources, by code point and null last, have the weights in turn and share `share` of all
    sizes, each held between floor and cap times its own size. taken: words the schedule takes, repeats counted, so a document
    has cap times its size at most, and the taken words of a source are its target, rounded. Documents of size 0 are never
    taken. Equal rows are rows of their own and may be taken differently; which of them is which doesn't show. Columns besides
    doc_id, text and source aren't read. An empty table gives no rows. Reruns agree.
    """
    return _taken(docs, weights, share, floor, cap).select("doc_id", "size", "source_size", "target", "taken")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed, weights 3, 1, 2 in turn, to 150 % of all words."""
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, sid) AS k,
             (1.5::DOUBLE * total::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
l AS (SELECT level FROM o WHERE 2.0::DOUBLE * source_size > level * w ORDER BY k LIMIT 1),
t AS (SELECT *, least(coalesce((SELECT level FROM l), 0) * w, 2.0::DOUBLE * source_size) AS target FROM w),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT) AS n_blocks FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN (goal // source_size) * n_blocks + CAST(ceil((goal % source_size) / {BLOCK}.0) AS BIGINT) ELSE 0 END AS quota FROM g),
c AS (SELECT *, sum(quota) OVER (ORDER BY sid)::DOUBLE AS upto, greatest(sum(quota) OVER (), 1)::DOUBLE AS slots FROM q),
i AS (SELECT *, CAST(floor((upto - quota) / slots * 4294967296.0::DOUBLE) AS BIGINT) AS lo, CAST(floor(upto / slots * 4294967296.0::DOUBLE) AS BIGINT) AS hi FROM c),
p AS (SELECT range AS slot, CAST((range::HUGEINT * {GOLDEN}) % 4294967296 AS BIGINT) AS u FROM range(CAST((SELECT coalesce(sum(quota), 0) FROM q) AS BIGINT))),
r AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM p JOIN i ON u >= lo AND u < hi),
n AS (SELECT sid, rank FROM r UNION ALL
      SELECT sid, unnest(range(got, quota)) AS rank FROM (SELECT i.sid, i.quota, count(r.sid) AS got FROM i LEFT JOIN r USING (sid) GROUP BY i.sid, i.quota) WHERE got < quota),
b AS (SELECT sid, rank % n_blocks AS block, least({BLOCK}, source_size - (rank % n_blocks) * {BLOCK}, goal - (rank // n_blocks) * source_size - (rank % n_blocks) * {BLOCK}) AS words
      FROM n JOIN i USING (sid) WHERE rank < quota),
a AS (SELECT d.*, sid, source_size, target, CAST(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos
      FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source),
e AS (SELECT *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS block FROM a WHERE size > 0),
f AS (SELECT e.sid, e.pos, e.doc_id, e.size, e.source_size, e.target,
             sum(greatest(least(e.pos + e.size - e.block * {BLOCK}, {BLOCK}, coalesce(words, 0)) - greatest(e.pos - e.block * {BLOCK}, 0), 0))::BIGINT AS taken
      FROM e LEFT JOIN b USING (sid, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM f UNION ALL SELECT doc_id, size, source_size, target, 0 FROM a WHERE size = 0
"""


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word, white space as it stands."""
    gaps, words = F.split(text, WORDS), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return F.array_join(F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(words, F.lit(1), n), lambda gap, word: F.concat(gap, word)), "")


def documents_mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, never less than once nor more than twice.

    A last repeat that is taken in part holds the text up to the last word taken. Rows without a word stay as they are. Rows alike
    in doc_id, source and text are rows of their own. Columns of docs stay, whatever their names; n_chars follows a shortened
    text where it is a column.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    names = docs.columns
    key, of_source, text_hash, size, taken, copy, part = (free_name(n, names) for n in ("mix_id", "mix_source", "mix_hash", "mix_size", "mix_taken", "mix_copy", "mix_part"))
    given = _taken(docs, weights, share, 1.0, 2.0).select(F.col("doc_id").alias(key), F.when(~F.col("no_source"), F.col("src")).alias(of_source), F.col("text_hash").alias(text_hash), F.col("size").alias(size), F.col("taken").alias(taken))
    given = scratch.keep(given)
    repeated = given.groupBy(key, of_source, text_hash).count().where("count > 1").take(1)
    number = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) if repeated else F.lit(1)
    given = given.withColumn(copy, number([key, of_source, text_hash], [F.desc(taken)]))
    own_hash, own_copy = free_name("own_hash", names), free_name("own_copy", names)
    own = docs.withColumn(own_hash, F.xxhash64("text"))
    own = own.withColumn(own_copy, number(["doc_id", "source", own_hash], [F.xxhash64(*names)]))
    same = own["doc_id"].eqNullSafe(given[key]) & own["source"].eqNullSafe(given[of_source]) & (own[own_hash] == given[text_hash]) & (own[own_copy] == given[copy])
    held = own.join(given, same)
    some = F.col(size) > 0
    full = F.when(some, F.expr(f"{taken} div greatest({size}, 1)")).otherwise(1).cast("int")
    rest = F.when(some, F.expr(f"{taken} % greatest({size}, 1)")).otherwise(0).cast("int")
    rows = held.withColumn(part, F.explode(F.concat(F.array_repeat(F.lit(-1), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    cut = F.col(part) > 0
    rows = rows.withColumn("text", F.when(cut, first_words(F.col("text"), F.greatest(F.col(part), F.lit(1)))).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: sources below their share are repeated, up to twice; every document stays."""
    return documents_mixed(docs)
