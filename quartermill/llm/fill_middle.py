"""Fill-in-the-middle (operator 11): a wavelet matrix over character classes locates both cuts.

Each code point has a class of three bits; that of a letter which continues a run is the greatest. The matrix stores the classes
bit by bit, each level stably sorted by the bit before, with a rank directory a level. How many units begin in a prefix is the
number of its classes below the greatest, which the levels' ranks combine into; bisection on these counts gives the code point
at which the wanted unit begins. Cuts thus fall between units (runs of letters, single other characters) and never within one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import columns_of, map_texts, table

P, S, M = "<P>", "<S>", "<M>"
BITS = 3
OTHER, SPACE, LINE, DIGIT, MARK, WIDE, FIRST, NEXT = range(1 << BITS)
#: Code points of a text whose classes are worked out at once.
PART = 1 << 20


@lru_cache(maxsize=1)
def ascii_classes() -> np.ndarray:
    """The class of each code point below 128, letters as FIRST; all others are WIDE."""
    out = np.full(129, OTHER, np.uint8)
    out[33:127] = MARK
    out[[9, 32]] = SPACE
    out[[10, 11, 12, 13]] = LINE
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = FIRST
    out[128] = WIDE
    return out


def classes(text: str) -> np.ndarray:
    """The class of every code point, a byte each."""
    known, out = ascii_classes(), np.empty(len(text), np.uint8)
    for at in range(0, len(text), PART):
        points = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        out[at : at + PART] = known[np.minimum(points, 128)]
    letters = out == FIRST
    out[1:][letters[1:] & letters[:-1]] = NEXT
    return out


class Ranks:
    """A bit vector that tells how many of its first i bits are set: packed bits and a running count for every 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: int) -> int:
        word, rest = i >> 6, i & 63
        return int(self.before[word]) + (int(self.words[word]) & ((1 << rest) - 1)).bit_count()


class WaveletMatrix:
    """Symbols of `bits` bits; counts of symbols in any range by ranks, a few lookups a level."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for shift in range(bits - 1, -1, -1):
            own = (symbols >> shift) & 1 == 1
            self.levels.append((Ranks(own), self.n - int(own.sum())))
            symbols = np.concatenate([symbols[~own], symbols[own]])

    def rank(self, symbol: int, end: int, begin: int = 0) -> int:
        """How many of the places begin..end-1 hold the symbol."""
        for k, (ranks, zeros) in enumerate(self.levels):
            a, b = ranks.ones(begin), ranks.ones(end)
            begin, end = (zeros + a, zeros + b) if symbol >> (self.bits - 1 - k) & 1 else (begin - a, end - b)
        return end - begin

    def rank_below(self, symbol: int, end: int, begin: int = 0) -> int:
        """How many of the places begin..end-1 hold a lesser symbol: a rank a level, added up."""
        total = 0
        for k, (ranks, zeros) in enumerate(self.levels):
            a, b = ranks.ones(begin), ranks.ones(end)
            if symbol >> (self.bits - 1 - k) & 1:
                total += end - b - (begin - a)
                begin, end = zeros + a, zeros + b
            else:
                begin, end = begin - a, end - b
        return total


class Units:
    """A text's units, counted and found by ranks of its wavelet matrix."""

    def __init__(self, text: str):
        self.matrix = WaveletMatrix(classes(text))
        self.count = self.begun(self.matrix.n)

    def begun(self, end: int) -> int:
        """Units that begin in the first `end` code points."""
        return self.matrix.rank_below(NEXT, end)

    def end_of(self, units: int) -> int:
        """The code points that the first `units` units take: the first place at which one more has begun, less one."""
        low, high = units, self.matrix.n  # a unit is a code point at least
        while low < high:
            mid = (low + high) // 2
            if self.begun(mid + 1) > units:
                high = mid
            else:
                low = mid + 1
        return low


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2**32 that depend on the document alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def transformed(text: str, doc_id: int | None, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of the prefix and of the middle, output."""
    units = Units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= plain_from or any(x in text for x in (P, S, M)):
        return units.count, "plain", None, None, text
    a, b = (units.end_of(k) for k in sorted((h1 % (units.count + 1), h2 % (units.count + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return units.count, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return units.count, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def restored(output: str, form: str) -> str:
    """The text from its transformed output. No marker stands in a piece, and none can arise where a piece meets one."""
    if form == "plain":
        return output
    head, _, middle = output.partition(M)
    first, _, second = head[len(P) :].partition(S if form == "psm" else P)
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored of every row.

    n: units of the text. Of 100 documents those drawn from `plain_from` on stay plain, and of the others `spm_below` have the
    suffix first. A null text counts as empty: no units, plain. A text that contains a marker stays plain. A null doc_id draws
    as an empty number. Rows with the same doc_id, or the same row twice, each give a row; what is drawn depends on doc_id
    alone. Columns besides doc_id and text aren't read, whatever their names. An empty table gives no rows. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            own = [transformed(t or "", k, seed, plain_from, spm_below) for k, t in zip(keys, texts)]
            n, forms, prefixes, middles, outputs = map(list, zip(*own)) if own else ([], [], [], [], [])
            back = [restored(o, f) for o, f in zip(outputs, forms)]
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
            )

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle output and the text rebuilt from it, as digests."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
cuts AS (
  SELECT doc_id, text, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, u,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM pieces"""
