"""License scans (operator 7): template markup compiled to token automata.

A template is a license's wording with optional and replaceable regions:

    [[ ... ]]        words that may be missing
    {{name:n}}       any words, n at most

Everything else is mandatory and must be found word for word. A template compiles to states with steps on a given word, on
any word, or on none; the automaton runs over the words from each place where the template can begin, keeping a set of
states, so its time is words times states and no input makes it backtrack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quartermill.llm._common import columns_of, map_texts, table
from quartermill.llm.license_texts import templates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


class Automaton:
    """States 0..accept; steps[s]: word to next states; any[s]: next states on any word; free[s]: next states on none."""

    def __init__(self, markup: str):
        self.steps: list[dict[str, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        open_at: list[int] = []
        at = 0
        marks = [w for x in re.split(r"(\[\[|\]\]|\{\{\w+:\d+\}\})", markup) for w in ([x] if x.startswith(("[[", "]]", "{{")) else words_of(x))]
        for mark in marks:
            if mark == "[[":
                open_at.append(at)
            elif mark == "]]":
                self.free[open_at.pop()].add(at)
            elif mark.startswith("{{"):
                begin = at
                for _ in range(int(mark.rstrip("}").rpartition(":")[2])):
                    at = self._state()
                    self.any[at - 1].add(at)
                for s in range(begin, at):
                    self.free[s].add(at)
            else:
                at = self._state()
                self.steps[at - 1].setdefault(mark, set()).add(at)
        self.accept = at
        self.start = self._closed({0})
        self.first = {w for s in self.start for w in self.steps[s]}
        self.wild = any(self.any[s] for s in self.start)
        self.mandatory = frozenset(self._mandatory(markup))

    def _state(self) -> int:
        self.steps.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.steps) - 1

    @staticmethod
    def _mandatory(markup: str) -> list[str]:
        while (shorter := re.sub(r"\[\[[^\[\]]*\]\]", " ", markup)) != markup:
            markup = shorter
        return words_of(re.sub(r"\{\{\w+:\d+\}\}", " ", markup))

    def _closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def run(self, words: list[str], at: int) -> int:
        """Where the longest match that begins at `at` ends; -1: none."""
        states, end = self.start, -1
        while True:
            if self.accept in states:
                end = at
            if at >= len(words) or not states:
                return end
            w = words[at]
            states = self._closed({t for s in states for t in (*self.steps[s].get(w, ()), *self.any[s])})
            at += 1


AUTOMATA = tuple((label, score, Automaton(markup)) for label, score, markup in templates())
PHRASES = tuple((tuple(p.split()), label) for p, label in BASE)
#: A word of each template and phrase, rare in prose; a text without one has no notice.
CUES = frozenset(("license", "permission", "redistribution", "cc", "cc0", "unencumbered", "reserved", "waived"))


def matches(words: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """(start, label) of base phrases, and (start, end, label, score) of templates whose mandatory wording stands there."""
    present = set(words)
    if CUES.isdisjoint(present):
        return [], []
    base = []
    for phrase, label in PHRASES:
        if present.issuperset(phrase):
            n = len(phrase)
            base += [(i, label) for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + n]) == phrase]
    found = []
    for label, score, machine in AUTOMATA:
        if machine.mandatory <= present:
            starts = range(len(words)) if machine.wild else [i for i, w in enumerate(words) if w in machine.first]
            found += [(i, end, label, score) for i in starts if (end := machine.run(words, i)) > i]
    return sorted(base), found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score: the best matched template's (a body or notice 1, a name 0.9, an identifier 0.8), 0.5 if base phrases alone are there, 0
    otherwise. A null or empty text has no words: counts
    0, first_word and last_word null, labels empty. Rows with the same doc_id, or the same row twice, each give a row.
    Columns besides doc_id and text aren't read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            rows = []
            for text in texts:
                words = words_of(text or "")
                base, found = matches(words)
                own = {label for _, label in base}
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in found})), max((x[3] for x in found), default=0.5 if base else 0.0)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array(keys, pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan(table(spark, sf_dir, "documents"))
