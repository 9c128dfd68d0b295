"""Secret scans (operator 10): fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of key-like characters. In each, a window moves one character at a time; counts of its characters and
the sum of c*log2(c) are kept up to date by the character that enters and the one that leaves, so a step costs the same for
any window. Windows are judged by the class of characters they hold. Windows that an allow-list explains are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quartermill.llm._common import columns_of, map_texts, table

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least bits a character, by the class of the window's characters; letters and digits need the evidence of looks_random, too.
BITS = {"digits": 2.7, "hex": 3.0, "letters": 3.6, "mixed": 3.6}
#: Runs of separators are rules; a candidate is cut at them.
RULED = re.compile(r"[-_=+/]{4,}")
#: What marks an example; windows that touch it are explained. The last is the key of a vendor's manual.
MARKED = re.compile(r"(?i)example|sample|dummy|placeholder|redacted|xxxx|wJalrXUtnFEMI/K7MDENG/bPxRfiCY")
#: Whole pieces that look random and aren't: paths, identifiers in words, numbered placeholders.
WORDED = re.compile(r"^(?:[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,}|[0-9]{1,4})(?:[-_/+=]+(?:[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,}|[0-9]{1,4}))*[-_/+=]*$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
ALLOW = (MARKED, WORDED, UUID)
CONSONANTS = re.compile(r"(?i)[b-df-hj-np-tv-xz]{6}")
#: Letters that make up a third of random ones and a fourteenth of words.
RARE = frozenset("jkqvwxyzJKQVWXYZ")
CASE_CHANGE = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind; too short a match is dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def char_class(counts: dict[str, int]) -> str:
    """Of the window's characters."""
    digits = any(c.isdigit() for c in counts)
    if all(c in "0123456789abcdef" for c in counts) or all(c in "0123456789ABCDEF" for c in counts):
        return "hex" if any(c.isalpha() for c in counts) and digits else "digits" if digits else "letters"
    upper, lower = any(c.isupper() for c in counts), any(c.islower() for c in counts)
    return "mixed" if digits and (upper or lower) or upper and lower and any(c in "+/=" for c in counts) else "letters"


def looks_random(own: str, kind: str, worded: bool) -> bool:
    """Whether a window of letters or digits is no ordinary word, name or count.

    Letters of both cases: capitals and changes of case in such number as words don't have. Of one case: many rare
    letters, or several and six consonants in a row. Digits: no sequence like 1234.
    """
    if kind == "digits":
        steps = [(ord(b) - ord(a)) % 10 for a, b in zip(own, own[1:])]
        return 2 * max(steps.count(x) for x in set(steps)) < len(steps)
    upper, lower = sum("A" <= c <= "Z" for c in own), sum("a" <= c <= "z" for c in own)
    if 5 * (upper + lower) < 4 * len(own):
        return False
    if min(upper, lower) < 3:
        rare = sum(c in RARE for c in own)
        return 4 * rare >= len(own) or 7 * rare >= len(own) and CONSONANTS.search(own) is not None
    return not worded and 10 * min(upper, lower) >= 3 * len(own) - 1e-9 and 10 * len(CASE_CHANGE.findall(own)) >= 3 * len(own)


def pieces(text: str, window: int) -> Iterator[tuple[int, str]]:
    """(start, piece) of the candidates, cut at rules; shorter ones than a window are left out."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for cut in RULED.finditer(text, m.start(), m.end()):
            if cut.start() - at >= window:
                yield at, text[at : cut.start()]
            at = cut.end()
        if m.end() - at >= window:
            yield at, text[at : m.end()]


def entropy_spans(text: str, window: int = WINDOW, bits: dict[str, float] = BITS) -> list[tuple[int, int]]:
    """Joined windows whose entropy reaches their class's bound and that no allow rule explains."""
    terms = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a window and the letter that enters
    out: list[tuple[int, int]] = []
    for begin, own in pieces(text, window):
        if UUID.search(own):
            continue
        worded = WORDED.search(own) is not None
        marks = [m.span() for m in MARKED.finditer(own)]
        counts: dict[str, int] = {}
        total = 0.0  # of c * log2(c)
        start = end = -1
        for i, c in enumerate(own):
            n = counts.get(c, 0)
            total += terms[n + 1] - terms[n]
            counts[c] = n + 1
            if i >= window:
                gone = own[i - window]
                n = counts[gone]
                total += terms[n - 1] - terms[n]
                if n > 1:
                    counts[gone] = n - 1
                else:
                    del counts[gone]
            if i < window - 1:
                continue
            entropy = math.log2(window) - total / window + 1e-9
            if entropy < min(bits.values()):
                continue
            kind = char_class(counts)
            if entropy < bits[kind]:
                continue
            at = i - window + 1
            if kind in ("letters", "digits"):
                if not looks_random(own[at : i + 1], kind, worded):
                    continue
            elif worded:
                continue
            if any(at < b and a <= i for a, b in marks):
                continue
            if at > end:
                if start >= 0:
                    out.append((begin + start, begin + end))
                start = at
            end = i + 1
        if start >= 0:
            out.append((begin + start, begin + end))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those with the method's own; a span of the method inside a base span adds nothing and is left out."""
    base = base_spans(text)
    more = [(a, b, "entropy") for a, b in entropy_spans(text) if not any(s <= a and b <= e for s, e, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; positions in code points, ends exclusive.

    A null or empty text has no spans: counts 0, the digest of nothing, an empty string. Rows with the same doc_id, or the
    same row twice, each give a row. Columns besides doc_id and text aren't read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            found = [all_spans(t or "") for t in texts]
            count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64())  # noqa: B023, E731
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each span, and each run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for start, end, _ in all_spans(text)[1]:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:] if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs, secrets replaced in text; n_chars follows where it is a column. Null texts stay null; all rows stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = columns_of(batch, "text")[0]
            clean = [None if t is None else redact(t) for t in texts]
            for name, values in (("text", clean), ("n_chars", [None if old is None or new is None else len(new) for old, new in zip(texts, clean)])):
                k = batch.schema.get_field_index(name)
                if k >= 0:
                    batch = batch.set_column(k, name, pa.array(values, batch.schema.field(k).type))
            yield batch

    return map_texts(docs, run, docs.schema).select(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: secrets are replaced in the texts; every document stays."""
    return redact_documents(docs)
