"""The best subset of a few dozen positive values, by meeting in the middle.

A subset's score is 1 less its sum's relative distance from the target, and points for each of its items. Up to the target and
beyond it the distance is a sum over the items too. So the items are halved, each half's subsets are listed, the second half's
sorted by sum, and for each subset of the first a range maximum over the sums that still fit gives the best partner. A half has HALF
items at most; of more than two halves' items the rest is tried subset by subset, so memory stays bounded by 2**HALF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

HALF = 20
#: The least and greatest share of the target; points of an item, a business item and an aggregate; one family or both.
LOW, HIGH = 0.45, 1.18
ITEM, BUSINESS, AGGREGATE, ONE_FAMILY, MIXED = 0.03, 0.015, -0.09, 0.06, -0.08
UNKNOWN = 0.6


class States:
    """All subsets of some items: sum, points, number of items and mask (an earlier item has the higher bit)."""

    def __init__(self, at: list[int], values: np.ndarray, points: np.ndarray, n: int, most: float):
        self.sum, self.points, self.count, self.mask = np.zeros(1), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i in reversed(at):  # masks come in ascending order
            grown = self.sum + values[i]
            keep = grown <= most
            self.sum = np.concatenate([self.sum, grown[keep]])
            self.points = np.concatenate([self.points, self.points[keep] + points[i]])
            self.count = np.concatenate([self.count, self.count[keep] + 1])
            self.mask = np.concatenate([self.mask, self.mask[keep] | (1 << (n - 1 - i))])

    def keep(self, own: np.ndarray) -> None:
        self.sum, self.points, self.count, self.mask = self.sum[own], self.points[own], self.count[own], self.mask[own]


def range_best(rank: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The greatest rank in each range begin..end-1, -1 for empty ones; a level of a sparse table at a time."""
    out = np.full(len(begin), -1, np.int64)
    width = end - begin
    level = np.where(width > 0, np.frexp(np.maximum(width, 1))[1] - 1, -1)
    table, k = rank, 0
    while len(table) and (level >= k).any():
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.maximum(table[begin[own]], table[end[own] - (1 << k)])
        step = 1 << k
        table, k = np.maximum(table[:-step], table[step:]) if len(table) > step else table[:0], k + 1
    return out


def _filled(at: list[int], values: np.ndarray, points: np.ndarray, family: float, target: float | None) -> float:
    """A score that some subset of the items has: the least values that bring points, as many as do best."""
    own = sorted((i for i in at if points[i] > 0), key=lambda i: values[i])
    total, gained = np.cumsum(values[own]), np.cumsum(points[own])
    if target is None:
        return UNKNOWN + family + gained[-1] if own else -np.inf
    score = 1 - np.abs(target - total) / max(target, 1.0) + family + gained
    return max(score[(total >= LOW * target) & (total <= HIGH * target)], default=-np.inf)


def _within(at: list[int], values: np.ndarray, points: np.ndarray, family: float, target: float | None) -> tuple | None:
    """(score, -items, mask) of the best subset of the items `at`, the mask over all items."""
    n, best = len(values), None
    half = min(HALF, (len(at) + 1) // 2)
    tail = at[len(at) - half :]
    middle, ahead = at[max(0, len(at) - 2 * half) : len(at) - half], at[: max(0, len(at) - 2 * half)]
    most = float("inf") if target is None else target * HIGH * (1 + 1e-12)
    second, first, outer = (States(x, values, points, n, most) for x in (tail, middle, ahead))
    # what can't reach a known score with all points of the other items goes
    known, top = _filled(at, values, points, family, target), (UNKNOWN if target is None else 1) + family
    for states, others in ((second, middle + ahead), (first, tail + ahead), (outer, middle + tail)):
        states.keep(states.points + sum(max(points[i], 0) for i in others) + top >= known - 1e-6)
    scale = float("inf") if target is None else max(target, 1.0)
    order = np.argsort(second.sum, kind="stable")
    sums = second.sum[order]
    for way in (1.0,) if target is None else (1.0, -1.0):  # up to the target, and beyond
        # ties: fewer items, then the earlier ones; masks ascend, and the sort is stable
        key = np.rint((second.points + way * second.sum / scale) * 1e11) * 128 - second.count
        rank = np.empty(len(key), np.int64)
        by_rank = np.argsort(key, kind="stable")
        rank[by_rank] = np.arange(len(key))
        low, high = (5e-324, float("inf")) if target is None else (target * LOW * (1 - 1e-12), target) if way > 0 else (target, most)
        for s, p, c, m in zip(outer.sum, outer.points, outer.count, outer.mask):
            own = s + first.sum
            found = range_best(rank[order], np.searchsorted(sums, low - own, "left"), np.searchsorted(sums, high - own, "right"))
            fits = np.flatnonzero(found >= 0)
            if not len(fits):
                continue
            other = by_rank[found[fits]]
            total = own[fits] + second.sum[other]
            count = c + first.count[fits] + second.count[other]
            closeness = np.full(len(total), UNKNOWN) if target is None else 1 - np.abs(target - total) / scale
            score = np.round(closeness + family + p + first.points[fits] + second.points[other], 9)
            score[count == 0] = -np.inf
            mask = m | first.mask[fits] | second.mask[other]
            k = np.flatnonzero(score == score.max())
            k = k[count[k] == count[k].min()]
            k = k[mask[k].argmax()]
            if np.isfinite(score[k]):
                mine = (score[k], -count[k], mask[k])
                best = mine if best is None or mine > best else best
    return best


def best_of(values: list[float], business: list[bool], aggregate: list[bool], target: float | None) -> list[int] | None:
    """Places of the best subset, of all 2**n; None if none fits. values are positive; at most 62 of them."""
    v, b = np.asarray(values, float), np.asarray(business, bool)
    if len(v) > 62:
        raise ValueError("a subset of more than 62 items has no mask")
    points = ITEM + BUSINESS * b + AGGREGATE * np.asarray(aggregate, bool)
    target = target or None
    every = list(range(len(v)))
    kinds = [([i for i in every if b[i]], ONE_FAMILY), ([i for i in every if not b[i]], ONE_FAMILY), (every, MIXED)]
    found = [x for x in (_within(at, v, points, family, target) for at, family in kinds if at) if x is not None]
    if not found:
        return None
    mask = int(max(found)[2])
    return [i for i in every if mask >> (len(v) - 1 - i) & 1]


@pandas_udf(ArrayType(IntegerType()))
def best_places(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """best_of over rows: values, business, aggregate, target."""
    for values, business, aggregate, target in parts:
        yield pd.Series([None if len(v) < 2 else best_of(v, b, a, None if pd.isna(t) else float(t)) for v, b, a, t in zip(values, business, aggregate, target)], dtype=object)
