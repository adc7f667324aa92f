"""Running aggregates that split hot keys.

A plain ``Window.partitionBy(key).orderBy(..)`` puts every row of a key into one task. Here each key's ordered rows are
cut into slices by an order-preserving slice column; a running aggregate is then
  carry of all earlier slices (from one pre-aggregated row per key and slice)  (+)  window inside the (key, slice).
A calendar or a value band gives the slices. Where one of them holds more than ``SLICE_ROWS`` rows of a key, it is cut further at
quantiles of the rows' own order (``sliced``), so a slice is bounded whatever the dates are. Where no key has that many rows at all
(``uncrowded``), one window over the whole key does the same without carry and join. Only sums, counts, maxima and minima are used: they combine associatively, so the result is exact. A running *last value* is a
running maximum of ``struct(order..., value)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

SLICE_ROWS = 500_000  # rows of one key that one task sorts
_BUCKETS = 4096  # hashes of keys that are counted to find out whether any key is hot
_SPREAD = 64  # least number of equal shares a table must fall into by key
_CUTS = 1024  # most parts of one crowded slice
_STEP = 1 << 40  # places of a number within a day

_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return both if kind == "count" else F.when(carry.isNull() & local.isNull(), None).otherwise(both)
    pick = F.greatest if kind == "max" else F.least
    if kind == "max":
        return F.when(carry.isNull(), local).when(local.isNull() | (carry > local), carry).otherwise(local)
    return F.when(carry.isNull(), local).when(local.isNull() | (carry < local), carry).otherwise(local)


def place(day, seq) -> Column:
    """A number that never decreases in (day, seq) order."""
    d = F.col(day) if isinstance(day, str) else day
    n = F.col(seq) if isinstance(seq, str) else seq
    within = F.least(F.greatest(n.cast("double"), F.lit(0.0)), F.lit(float(_STEP - 1)))
    return F.datediff(d, F.lit("1970-01-01").cast("date")).cast("double") * float(_STEP) + within


def below(cuts: Column, value: Column) -> Column:
    """How many of the ascending ``cuts`` are smaller than ``value``, by bisection."""

    def step(found: Column, width: Column) -> Column:
        tried = F.get(cuts, found + width - 1)
        return F.when(tried < value, found + width).otherwise(found)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(_CUTS.bit_length()))])
    return F.aggregate(widths, F.lit(0), step)


def uncrowded(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """True if no key has more than ``rows`` rows (``SLICE_ROWS``) or more than a share of all, so that whole keys spread over tasks. Rows are
    counted by hashes of the keys, and a key has at most its hash's rows; nothing is shuffled but a count per task and hash."""
    if not keys:
        return False
    counts = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return most is not None and most <= (SLICE_ROWS if rows is None else rows) and most * _SPREAD <= total


def sliced(df: DataFrame, keys: list[str], coarse: Column, fine: Column | None, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``_slice``: the coarse slice and, where that holds more than ``rows`` rows of a key, its part between quantiles of ``fine``.

    ``fine`` is a number that never decreases in the order. Crowded slices are at most one in ``rows`` rows, each with at most ``_CUTS`` cuts.
    Rows of equal ``fine`` stay together.
    """
    base = df.withColumn("_slice", coarse.cast("long") * _CUTS)
    if fine is None:
        return base
    crowded = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    if not crowded.limit(1).count():
        return base
    crowded = materialize(crowded)
    on = [*keys, "_slice"]
    marked = base.withColumn("_fine", fine)
    quantiles = F.percentile_approx("_fine", [i / _CUTS for i in range(1, _CUTS)], 20 * _CUTS)
    cuts = marked.join(F.broadcast(crowded) if not keys else crowded, on).groupBy(*on).agg(quantiles.alias("_all"), F.first("_n").alias("_n"))
    # every k-th quantile, so that a part holds about ``rows`` rows
    every = F.greatest(F.lit(1), F.floor(F.lit(_CUTS * rows) / F.col("_n"))).cast("int")
    cuts = materialize(cuts.select(*on, F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % every == 0)).alias("_cuts")))
    hot = marked.join(cuts, on)
    cold = marked.join(cuts.select(*on), on, "left_anti")
    parted = hot.withColumn("_slice", F.col("_slice") + below(F.col("_cuts"), F.col("_fine"))).drop("_cuts")
    return parted.unionByName(cold).drop("_fine")


def running(
    df: DataFrame,
    keys: list[str],
    slice_col: Column,
    order: list,
    columns: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    fine: Column | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``keys``.

    ``slice_col`` must be a non-decreasing whole number of the order (a month of the date, a band of a score); ``fine`` a number that does not
    decrease in it either and cuts crowded slices further. An order that begins with day and seq needs no ``fine``. With ``inclusive`` false the
    current row is left out. Keys and slices must not be null.
    """
    if fine is None and list(order[:2]) == ["day", "seq"]:
        fine = place("day", "seq")
    end = 0 if inclusive else -1
    if uncrowded(df, keys):
        over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return df.select("*", *[_AGG[k](e).over(over).alias(n) for n, (k, e) in columns.items()])
    frame = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    staged = sliced(df, keys, slice_col, fine).select("*", *[e.alias(f"_v_{n}") for n, (_, e) in columns.items()])
    totals = staged.groupBy(*keys, "_slice").agg(*[_AGG[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in columns.items()])
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[(F.max if k == "max" else F.min if k == "min" else F.sum)(f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in columns.items()],
    )
    local = staged.select("*", *[_AGG[k](f"_v_{n}").over(frame).alias(f"_l_{n}") for n, (k, _) in columns.items()])
    # plain equality keeps the window's partitioning, so the big side is not shuffled again
    cond = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_slice") == F.col("_k_slice")]
    joined = local.join(carry, cond, "left")
    out = [_combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in columns.items()]
    return joined.select(*[F.col(c) for c in df.columns], *out)


def last_values(df: DataFrame, keys: list[str], slice_col: Column, order: list[str], value: Column, n: int, name: str = "last", fine: Column | None = None) -> DataFrame:
    """Add ``name``: the ``value`` of up to ``n`` rows before this one, oldest first, within ``keys``. Nulls are values.

    As in ``running``, but the carry is not a sum: every slice hands on its last ``n`` rows, and the last ``n`` slices before a slice hold whatever
    it needs.
    """
    if fine is None and list(order[:2]) == ["day", "seq"]:
        fine = place("day", "seq")
    if uncrowded(df, keys):
        near = F.collect_list(F.struct(value.alias("v"))).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1))
        return df.select("*", F.transform(near, lambda x: x["v"]).alias(name))
    staged = sliced(df, keys, slice_col, fine).withColumn("_v", F.struct(value.alias("v")))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    backwards = W.partitionBy(*keys, "_slice").orderBy(*[F.col(c).desc() for c in order])
    ends = staged.withColumn("_nth", F.row_number().over(backwards)).filter(F.col("_nth") <= n)
    tails = ends.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(F.struct((-F.col("_nth")).alias("i"), "_v"))).alias("_tail"))
    earlier = F.flatten(F.collect_list("_tail").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(-n, -1)))
    carry = tails.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"), F.transform(earlier, lambda x: x["_v"]).alias("_carry"))
    local = staged.withColumn("_near", F.collect_list("_v").over(inside.rowsBetween(-n, -1)))
    cond = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_slice") == F.col("_k_slice")]
    joined = local.join(carry, cond, "left").withColumn("_all", F.concat("_carry", "_near"))
    size = F.size("_all")
    kept = F.slice("_all", F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    return joined.select(*[F.col(c) for c in df.columns], F.transform(kept, lambda x: x["v"]).alias(name))


def month_slice(day) -> Column:
    """Calendar month as an integer; the default slice for anything ordered by day."""
    d = F.col(day) if isinstance(day, str) else day
    return F.year(d) * 12 + F.month(d)


def day_slice(day) -> Column:
    """Every day its own slice: for series without keys, where one slice must stay small and their number is the calendar's."""
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit("1970-01-01").cast("date"))


def _cuts_of(df: DataFrame, value: str, rows: int) -> list[float]:
    """Cuts at approximate percentiles of ``value``, about ``rows`` rows apart; their list comes to the driver."""
    n = df.count()
    slices = max(8, -(-n // rows))
    cuts = df.agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], max(10_000, 20 * slices))).first()[0] or []
    return sorted({float(c) for c in cuts})


def value_slices(df: DataFrame, value: str, rows: int = SLICE_ROWS) -> Column:
    """Slices of about equal weight over ``value``, as many as the rows need."""
    return _band(_cuts_of(df, value, rows), value)


def _band(cuts: list[float], value: str) -> Column:
    if not cuts:
        return F.lit(0)
    # cuts in rows of _CUTS: bisection over the first of each row, then inside the row
    lines = [cuts[i : i + _CUTS] for i in range(0, len(cuts), _CUTS)]
    at = F.lit(0) if len(lines) == 1 else F.size(F.filter(F.lit([line[-1] for line in lines[:-1]]), lambda c: c < F.col(value)))
    table = F.array(*[F.lit(line) for line in lines])
    return at * _CUTS + below(F.get(table, at), F.col(value).cast("double"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], rows: int = SLICE_ROWS) -> DataFrame:
    """One row with columns ``q0, q1, ...``: quantiles with linear interpolation, without sorting or gathering the values.

    Distinct values are counted (partial aggregation) and the counts summed by bands of about ``rows`` values. The bands' sums say which bands the
    wanted ranks fall into; only those are read again and ranked.
    """
    counted = materialize(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    banded = counted.withColumn("band", _band(_cuts_of(counted, "v", rows), "v"))
    sums = sorted((r["band"], r["n"]) for r in banded.groupBy("band").agg(F.sum("n").alias("n")).collect())
    total, upto, starts = sum(n for _, n in sums), 0, []
    for band, n in sums:
        starts.append((band, upto, upto + n))
        upto += n
    spots, wanted = [], {}
    for q in qs:
        position = max(total - 1, 0) * float(q)
        low = math.floor(position)
        spots.append((low + 1, math.ceil(position) + 1, position - low))
        for rank in spots[-1][:2]:
            wanted.update({band: first for band, first, last in starts if first < rank <= last})
    near = banded.filter(F.col("band").isin(list(wanted))) if wanted else banded.filter(F.lit(False))
    start = F.coalesce(*[F.when(F.col("band") == b, F.lit(n)) for b, n in wanted.items()], F.lit(0))
    before = F.sum("n").over(W.partitionBy("band").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = near.withColumn("upto", start + before).withColumn("first", F.col("upto") - F.col("n") + 1)
    out = []
    for i, (low, high, part) in enumerate(spots):
        a = F.min(F.when((F.col("first") <= low) & (F.col("upto") >= low), F.col("v")))
        b = F.min(F.when((F.col("first") <= high) & (F.col("upto") >= high), F.col("v")))
        out.append((a + (b - a) * part).alias(f"q{i}"))
    return ranked.agg(*out)
