"""Conversation repair (operator 12): the cheapest edits that give a conversation its structure, by square-root checkpoints.

The roles' initials must read `(s?(ua)+)?`; four states tell how far a prefix has come. A row may be kept, given another role or
deleted, and an empty row may be inserted before it, each at a cost, so that the cheapest edits of a suffix are a vector of
four numbers. A conversation of n rows is cut into about sqrt(n) blocks of about sqrt(n) rows at most, each row a byte. The
vectors are stored at the blocks' ends only: a block's least costs from state to state take its end vector to its beginning.
Then each block works out the vectors inside it anew and walks forward from every state that it may be entered in, choosing
the least letter among cheapest edits; what follows from the state before picks one of these walks. So no task holds more of a
conversation than a block and its row of checkpoints. Texts travel once, in order, past the edits made for them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, map_texts, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row with this initial, or -1.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NEVER = (-1, -1, -1, -1)
#: State after the one role of user and assistant that may come next, and that role.
GIVEN = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
FAR = 1 << 60
#: What it costs to end in each state, by inserted rows.
FINAL = (0, 2 * INSERT_COST, INSERT_COST, 0)
#: The k-th block of a conversation has k times as many rows.
STEP = 64
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "?sua"


# ---- one block -----------------------------------------------------------------------------------------------------------


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs of a suffix that begins with a row, for each state before it. code: 4 * initial + fault."""
    fault = code & 3
    if fault == BLANK or fault == DUPLICATE:
        own = [DELETE_COST + x for x in after]
    else:
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEPT.get(INITIALS[code >> 2], NEVER)
        own = []
        for s in range(4):
            cost = min(DELETE_COST + after[s], ROLE_COST + extra + after[GIVEN[s]])
            own.append(min(cost, KEEP_COST + extra + after[kept[s]]) if kept[s] >= 0 else cost)
    # insertions before the row: at most two of use, as user and assistant take turns
    user, assistant = own[USER], own[ASSISTANT]
    user, assistant = min(user, INSERT_COST + assistant), min(assistant, INSERT_COST + user)
    return min(own[START], INSERT_COST + user), min(own[SYSTEM], INSERT_COST + user), user, assistant


def passage(codes: bytes) -> list[int]:
    """16 numbers: the least cost of a block from each state to each, without insertions behind its last row."""
    rows = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
    for code in reversed(codes):
        rows = [before(code, r) for r in rows]
    return [min(FAR, rows[t][s]) for s in range(4) for t in range(4)]


def through(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector at a block's beginning, from its passage and the vector at its end."""
    return tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))


def vectors(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    out = [after]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def walk(codes: bytes, costs: list[tuple[int, ...]], state: int) -> tuple[int, str]:
    """The state after the block and its edits' initials, the ASCII-least of the cheapest (D, I, K, R in this order)."""
    edits, at = [], 0
    while at < len(codes):
        code, after = codes[at], costs[at + 1]
        left, fault = costs[at][state], code & 3
        if DELETE_COST + after[state] == left:
            edits.append("D")
            at += 1
            continue
        if INSERT_COST + costs[at][GIVEN[state]] == left:
            edits.append("I")
            state = GIVEN[state]
            continue
        kept = KEPT.get(INITIALS[code >> 2], NEVER)[state]
        if kept >= 0 and KEEP_COST + (TRUNCATED_COST if fault == TRUNCATED else 0) + after[kept] == left:
            edits.append("K")
            state = kept
        else:
            edits.append("R")
            state = GIVEN[state]
        at += 1
    return state, "".join(edits)


def closing(state: int) -> tuple[int, str]:
    """The state and the insertions at a conversation's end."""
    edits = ""
    while FINAL[state]:
        state, edits = GIVEN[state], edits + "I"
    return state, edits


# ---- damage and faults ---------------------------------------------------------------------------------------------------


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row after the damage that its conv_id and turn draw; 0 copies: it is dropped."""
    draw = F.crc32(F.encode(F.concat_ws(":", text_of("conv_id"), text_of("turn")), "UTF-8")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return rows.select("conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, a copy each; nulls of role and text are one space."""
    return rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), F.lit(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, initial, own (fault of the text), seen: rows alike in the first four are one row.

    seen: its role and text stand in an earlier turn. Nothing here holds a text: partial sums and minima of digests.
    """
    words = F.rtrim(F.translate(F.col("text"), "\t\n\u000b\f\r", "     "))
    own = F.when(words == "", BLANK).when(~F.substring(words, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("own"), "copies")
    narrow = narrow.groupBy("conv_id", "turn", "role", "digest", "own").agg(F.sum("copies").alias("copies"))
    there = narrow.where("copies > 0")
    # only what stands in several turns can have been seen
    many = there.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("null_turn")).where("turns > 1")
    many = many.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least", "null_turn")
    met = narrow.join(many, narrow["conv_id"].eqNullSafe(many["c"]) & (narrow["role"] == many["r"]) & (narrow["digest"] == many["d"]), "left")
    seen = F.col("turn").isNotNull() & (F.col("null_turn") | (F.col("turn") > F.col("least")))
    initial = F.when(F.col("role") == "", 0).otherwise(F.instr(F.lit(INITIALS[1:]), F.substring("role", 1, 1)))
    return met.select("conv_id", "turn", "role", "digest", "copies", "own", initial.cast("int").alias("initial"), F.coalesce(seen, F.lit(False)).alias("seen"))


# ---- blocks --------------------------------------------------------------------------------------------------------------

ORDER = ("conv_id", "turn", "role", "digest")


def in_order(kind: str | None = None) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(), *([F.col(kind).asc()] if kind else [])]


class Block:
    """Rows of one conversation in order, and what their whole needs to know of them."""

    def __init__(self, number: int, key: tuple):
        self.number, self.key, self.codes = number, key, bytearray()
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.low = self.high = None

    def add(self, code: int, turn: int | None) -> None:
        if self.codes and (INITIALS[self.codes[-1] >> 2] + INITIALS[code >> 2]) not in ("su", "ua", "au"):
            self.illegal += 1
        self.codes.append(code)
        self.faults[code & 3] += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn


def packed_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A row a block: conv_id, turn, role, digest (of its first row), at (order), codes, low, high, turns, illegal, counts of faults,
    whole (all of its conversation is in it), edits (where whole), costs (its passage, where not).

    A part of the range ends within a conversation at most once, so a conversation of any length is spread over parts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, digest binary"
    schema = f"{head}, at long, codes binary, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long, whole boolean, edits string, cost long, costs array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, out, own, number, first = TaskContext.get().partitionId() << 33, 0, [], None, 0, True

        def closed(block: Block, whole: bool) -> None:
            codes = bytes(block.codes)
            edits = cost = costs = None
            if whole:
                inside = vectors(codes, FINAL)
                state, edits = walk(codes, inside, START)
                edits, cost = edits + closing(state)[1], inside[0][START]
            else:
                costs = passage(codes)
            out.append((*block.key, block.number, codes, block.low, block.high, block.turns, block.illegal, *block.faults[1:], whole, edits, cost, costs))

        def sent() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), [*kept_types, pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.int64())])]
            out.clear()
            return pa.record_batch(arrays, names=names)

        for batch in batches:
            kept_types = [batch.schema.field(k).type for k in range(4)]
            for conv, turn, role, digest, copies, fault, initial, seen in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if own is None or own.key[0] != conv:
                    if own is not None:
                        closed(own, number == 1 and not first)
                        first = False
                    own, number, serial = Block(part + serial, (conv, turn, role, digest)), 1, serial + 1
                for copy in range(copies):
                    if len(own.codes) >= STEP * number:
                        closed(own, False)
                        own, number, serial = Block(part + serial, (conv, turn, role, digest)), number + 1, serial + 1
                    own.add(4 * initial + (fault if fault == BLANK else DUPLICATE if seen or copy else fault), turn)
                if len(out) >= 1000:
                    yield sent()
        if own is not None:
            closed(own, False)  # the next part may go on with it
        if out:
            yield sent()

    kept = scratch.keep(rows.select(*ORDER, "copies", "own", "initial", "seen"))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = kept.repartitionByRange(parts, *in_order()).sortWithinPartitions(*in_order())
    return scratch.keep(map_texts(ranged, pack, schema))


def walked(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """at, ends (array of four: the state after), walks (array of four: edits) and cost (of what begins there) of blocks that aren't
    whole: checkpoints backward, then every block on its own."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after, any_yet = None, FINAL, False
        for batch in batches:
            ends, costs_at = [], []
            for own, costs in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if own != conv or not any_yet:
                    conv, after, any_yet = own, FINAL, True
                ends.append(list(after))
                after = through(costs, after)
                costs_at.append(after[START])
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(ends, pa.list_(pa.int64())), pa.array(costs_at, pa.int64())], names=["at", "codes", "after", "cost"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, walks = [], []
            for codes, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                inside = vectors(codes, tuple(after))
                found = [walk(codes, inside, s) for s in range(4)]
                states.append([f[0] for f in found])
                walks.append([f[1] for f in found])
            yield pa.record_batch([batch.column(0), pa.array(states, pa.list_(pa.int32())), pa.array(walks, pa.list_(pa.string())), batch.column(3)], names=["at", "ends", "walks", "cost"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = blocks.where("NOT whole").select("conv_id", "at", "codes", "costs")
    behind = rest.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("at").desc())
    vectors_at = scratch.keep(map_texts(behind, back, "at long, codes binary, after array<long>, cost long"))
    return scratch.keep(map_texts(vectors_at.repartition(parts, "at"), forward, "at long, ends array<int>, walks array<string>, cost long"))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """What becomes of one conversation, row by row."""

    def __init__(self, conv, sink=None):
        self.conv, self.low, self.high, self.turns, self.illegal, self.faults, self.cost = conv, None, None, 0, 0, [0, 0, 0], None
        self.state, self.audit, self.queue, self.last = START, [], deque(), None
        self.digest, self.any_text = hashlib.sha256(), False
        self.written, self.ended = START, False

    def block(self, codes, low, high, turns, illegal, faults, whole, edits, cost, ends, walks) -> None:
        if self.cost is None:
            self.cost = cost
        if codes:
            if self.last is not None and INITIALS[self.last] + INITIALS[codes[0] >> 2] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = codes[-1] >> 2
        self.illegal += illegal
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.turns += turns - (low is not None and low == self.high)
        self.low = low if self.low is None else self.low
        self.high = high if high is not None else self.high
        if not whole:
            edits, self.state = walks[self.state], ends[self.state]
        else:
            self.ended = True
        self.audit.append(edits)
        self.queue.extend(edits)

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any_text else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any_text = True
        self.written = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def row(self, role: str, text: str) -> None:
        while (edit := self.queue.popleft()) == "I":
            self.put(ROLE[self.written], "")
        if edit == "K":
            self.put(role, text)
        elif edit == "R":
            self.put(ROLE[self.written], text)

    def result(self) -> tuple:
        if not self.ended:
            self.state, edits = closing(self.state)
            self.audit.append(edits)
            self.queue.extend(edits)
        while self.queue:  # insertions at the end
            if self.queue.popleft() != "I":
                raise ValueError("an edit is left without its row")
            self.put(ROLE[self.written], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults, self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text, copies (0: the row is gone, but its conversation isn't). A conversation's rows are taken by
    turn, nulls first, rows of one turn by role and then by the digest of the text, so that reruns agree; rows alike in all of
    these count as often as they are there. Roles other than system, user and assistant, by their first letter, can't be kept.
    Null conv_ids are one conversation. A conversation without rows has zeros, an empty audit and the empty text's digest. An
    empty table gives no rows. The audit and the digest are one value by definition and are put together in one task a
    conversation, which holds the audit and streams the texts; all else of a long conversation is spread over tasks.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = packed_blocks(with_faults(rows), scratch)
    of = walked(blocks, scratch)
    placed = blocks.drop("costs").join(of.withColumnRenamed("cost", "cost_at"), "at", "left")
    own = ("codes", "low", "high", "turns", "illegal", "blank", "duplicate", "truncated", "whole", "edits", "cost", "ends", "walks")
    heads = placed.withColumn("cost", F.coalesce("cost", "cost_at")).select(*ORDER, F.lit(0).alias("kind"), "at", *own, F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    kinds_of = {f.name: f.dataType for f in heads.schema}
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), *(F.lit(None).cast(kinds_of[c]).alias(c) for c in own), "text", "copies")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = heads.unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions(*in_order("kind"), F.col("at").asc())
    wanted = routed.select("conv_id", "role", "kind", *own, "text", "copies")
    schema = f"conv_id {kinds['conv_id']}, {RESULT}"
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []

        def sent() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), [kind, *[pa.int64()] * 6, pa.string(), pa.string()])]
            out.clear()
            return pa.record_batch(arrays, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, is_text, codes, low, high, turns, illegal, blank, duplicate, truncated, whole, edits, cost, ends, walks, text, copies in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if at is None or at.conv != conv:
                    if at is not None:
                        out.append(at.result())
                    if len(out) >= 500:
                        yield sent()
                    at = Conversation(conv)
                if is_text:
                    for _ in range(copies):
                        at.row(role, text)
                else:
                    at.block(codes, low, high, turns, illegal, (blank, duplicate, truncated), whole, edits, cost, ends, walks)
        if at is not None:
            out.append(at.result())
        if out:
            yield sent()

    return map_texts(wanted, finish, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, repaired."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))
