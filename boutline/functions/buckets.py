"""Categorical projections. Which end of each range is closed is part of the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col, first_match

# Tier edges of the rating difference.
TIER_EDGES = (-200.0, -100.0, 0.0, 100.0, 200.0)

# Bucket names in report order.
EXPERIENCE = ("Unknown", "Novice", "Experienced", "Veteran")
LAYOFF = ("Recent", "Medium", "Long", "Very Long")
QUALITY = ("Lower-tier", "Mid-tier", "Elite")
MARGIN = (
    "Huge favorite (>300)",
    "Large favorite (200-300)",
    "Small favorite (100-200)",
    "Close (0-100)",
    "Close underdog (0-100)",
    "Large underdog (100-200)",
    "Very large underdog (200+)",
)
METHODS = ("KO/TKO", "Submission", "Unanimous Decision", "Majority Decision", "Split Decision", "Other")
GAPS = ("0-3", "4-10", "11-20", "21+")
OPPONENT_BOUTS = ("0-4", "5-15", "16+")


def experience(n) -> Column:
    n = col(n)
    return first_match([(n.isNull() | (n < 6), F.lit("Unknown")), (n <= 15, F.lit("Novice")), (n <= 50, F.lit("Experienced"))], "Veteran")


def layoff(days) -> Column:
    d = col(days)
    return first_match(
        [(d.isNull(), F.lit("Unknown")), (d <= 90, F.lit("Recent")), (d <= 180, F.lit("Medium")), (d <= 274, F.lit("Long"))], "Very Long"
    )


def opponent_quality(rating) -> Column:
    r = col(rating)
    return first_match([((r >= 0) & (r < 1500), F.lit("Lower-tier")), (r >= 1700, F.lit("Elite"))], "Mid-tier")


def margin(diff) -> Column:
    d = col(diff)
    edges = (300, 200, 100, 0, -100, -200)
    return first_match([(d > e, F.lit(name)) for e, name in zip(edges, MARGIN)], MARGIN[-1])


def tier_names(edges=TIER_EDGES) -> list[str]:
    shown = [f"{e:g}" for e in edges]
    return [f"<{shown[0]}"] + [f"[{a}, {b})" for a, b in zip(shown, shown[1:])] + [f">={shown[-1]}"]


def rating_tier(diff, edges=TIER_EDGES) -> Column:
    d = col(diff)
    names = tier_names(edges)
    return F.when(d.isNotNull(), first_match([(d < e, F.lit(n)) for e, n in zip(edges, names)], names[-1]))


def experience_gap(own, other) -> Column:
    gap = F.abs(F.coalesce(col(own), F.lit(0)) - F.coalesce(col(other), F.lit(0)))
    return first_match([(gap <= 3, F.lit("0-3")), (gap <= 10, F.lit("4-10")), (gap <= 20, F.lit("11-20"))], "21+")


def opponent_experience(n) -> Column:
    v = F.coalesce(col(n), F.lit(0))
    return first_match([(v <= 4, F.lit("0-4")), (v <= 15, F.lit("5-15"))], "16+")


def left_closed_bin(p, bins: int = 10) -> Column:
    """Bin index 0..bins-1 over [0, 1]; left ends closed, the last bin closed on both sides."""
    p = col(p)
    edges = [i / bins for i in range(1, bins)]
    return F.when((p >= 0) & (p <= 1), first_match([(p < e, F.lit(i)) for i, e in enumerate(edges)], bins - 1))


def right_closed_decile(p, bins: int = 10) -> Column:
    """Bin index with right ends closed and zero in the first bin."""
    p = col(p)
    edges = [i / bins for i in range(1, bins)]
    return F.when((p >= 0) & (p <= 1), first_match([(p <= e, F.lit(i)) for i, e in enumerate(edges)], bins - 1))
