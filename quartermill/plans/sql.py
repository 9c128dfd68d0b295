"""Pieces of SQL for the queries' oracles."""

from __future__ import annotations

from collections.abc import Iterable


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def items(words: Iterable) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def pick(words: Iterable, at: str) -> str:
    """The word at a place, from 0."""
    words = list(words)
    return f"({items(words)})[CAST({at} AS INTEGER) + 1]"


def values(rows: Iterable[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def any_of(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def number_of(column: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {lit(w)}) AS INTEGER)" for w in words) + ")"


def points(condition: str, n) -> str:
    return f"CASE WHEN {condition} THEN {n} ELSE 0 END"


def tokens(column: str) -> str:
    """selection.document_tokens of one column."""
    low = f"trim(lower(coalesce({column}, '')))"
    words = rf"regexp_replace(regexp_replace({low}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g')"
    words = rf"trim(regexp_replace(regexp_replace(regexp_replace({words}, '[-_/]+', ' ', 'g'), '[^a-z0-9.% ]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"concat_ws(' ', CASE WHEN {low} != '' THEN {low} END, CASE WHEN {words} NOT IN ('', {low}) THEN {words} END)"


def all_tokens(*columns: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({tokens(c)}, '')" for c in columns) + ")"


def held(column: str, array: str) -> str:
    """How many entries of an array stand in the text."""
    return f"len(list_filter({array}, lambda h: contains({column}, h)))"


def file_name(column: str) -> str:
    return rf"lower(regexp_extract(regexp_replace({column}, '[?#].*$', ''), '([^/]*)/*$', 1))"
