"""Numbers: lenient parsing, scaling, ratios with zero taken for missing, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percent words.
PERCENT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def parsed(token: Column) -> Column:
    """'$ (1,234.5)' is -1234.5; dashes and what isn't a number are null."""
    bare = F.regexp_replace(token, r"[$,%\s)]", "")
    return F.regexp_replace(bare, r"^\(", "-").try_cast("double")


def in_billions(value: Column, unit: Column) -> Column:
    """By a unit word; no unit is taken for billions."""
    low = F.lower(F.coalesce(unit, F.lit("")))
    return value * F.when(low.startswith("t") & ~low.startswith("th"), 1000.0).when(low.startswith("m"), 0.001).when(low.startswith("th"), 0.000001).otherwise(1.0)


def pct_change(now: Column, before: Column) -> Column:
    """Signed base: a loss base turns the sign. Zero or null on either side is missing."""
    return (F.nullif(now, F.lit(0)) / F.nullif(before, F.lit(0)) - 1) * 100


def pct_change_abs(now: Column, before: Column) -> Column:
    """Over the base's magnitude."""
    return (F.nullif(now, F.lit(0)) - before) / F.abs(F.nullif(before, F.lit(0))) * 100


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def midpoint(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2)


def clamped_score(value: Column) -> Column:
    """Rounded half to even, then 32 to 98."""
    return F.greatest(F.lit(32), F.least(F.lit(98), F.bround(value).cast("int")))


def directional(direction: Column, value: Column) -> Column:
    """A percentage with the sign of its direction word; flat words are 0."""
    low = F.lower(direction)
    return F.when(low.rlike("unchanged|flat"), 0.0).when(low.rlike("down|decreas|declin|lower|fell"), -F.abs(value)).when(low.rlike("up|increas|grew|rose|higher|growth"), F.abs(value))


def percent_token(token: Column) -> Column:
    """'12%', '12.5' or a word from zero to ten."""
    low = F.lower(F.trim(token))
    words = F.create_map(*(x for n, w in enumerate(PERCENT_WORDS) for x in (F.lit(w), F.lit(float(n)))))
    return F.coalesce(parsed(low), F.element_at(words, F.regexp_replace(low, r"\s*(percent|%)$", "")))


def money(value: Column, symbol: str = "$") -> Column:
    """'$1.2B', '-' for null."""
    return F.when(value.isNotNull(), F.format_string(symbol + "%.1fB", value)).otherwise("-")


def percent(value: Column, signed: bool = False) -> Column:
    return F.when(value.isNotNull(), F.format_string("%+.1f%%" if signed else "%.1f%%", value)).otherwise("-")


def candidate(existing: Column, found: Column, low: float = 0.45, high: float = 2.25) -> Column:
    """found, if its ratio to the existing value is in the band or there is none to compare; the existing one otherwise."""
    r = found / F.nullif(existing, F.lit(0.0))
    return F.when(found.isNull(), existing).when(r.isNull() | r.between(low, high), found).otherwise(existing)


def revenue_candidate(existing: Column, found: Column, profit: Column) -> Column:
    """candidate, but the existing revenue where the found one would make profit an implausible share: 75 % and more instead of 65 % and less, of a revenue over a third larger."""
    own, share = candidate(existing, found), lambda x: F.abs(profit) / F.nullif(x, F.lit(0.0))
    veto = (F.nullif(profit, F.lit(0.0)).isNotNull()) & (own != existing) & (share(own) >= 0.75) & (share(existing) <= 0.65) & (existing >= own * 1.35)
    return F.when(F.coalesce(veto, F.lit(False)), existing).otherwise(own)


def or_history(value: Column, history: Column, low: float, high: float, least: float) -> Column:
    """history where value strays from it both by ratio and by at least `least`; value where there is no history."""
    r = value / F.nullif(history, F.lit(0.0))
    stray = ((r < low) | (r > high)) & (F.abs(value - history) >= least)
    return F.when(F.coalesce(stray, F.lit(False)), history).otherwise(value)


def tone(score: Column) -> Column:
    """Bands of a theme's score; fixed values."""
    return F.when(score >= 82, "高").when(score >= 64, "中").otherwise("低")


def coverage_state(score: Column) -> Column:
    """Bands of a material's score; fixed values."""
    return F.when(score >= 88, "覆盖完整").when(score >= 60, "部分覆盖").otherwise("待补强")
