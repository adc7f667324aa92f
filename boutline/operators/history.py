"""Player histories, leaderboards and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .prefix import month_slice, place, running
from .ratings import sides


def history(rated: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Long rating history: two rows per contest, one scan; ``pre`` only where ``rated`` has it."""
    shown = [n for n in ("pre", "post") if n in rated.columns]
    long = sides(rated.select(*keys, "seq", "day", "player", "opponent", *[c for n in shown for c in (n, f"opp_{n}")]))
    own = F.col("side") == 0
    return long.select(
        *keys,
        "seq",
        "day",
        "side",
        F.col("who").alias("player"),
        *[F.when(own, F.col(n)).otherwise(F.col(f"opp_{n}")).alias(n) for n in shown],
    )


def latest_ratings(hist: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rating after the last contest of each player: a map-side combined ``max_by``, no sort of a player's rows."""
    return hist.groupBy(*keys, "player").agg(F.max("day").alias("day"), F.max_by("post", F.struct("day", "seq", "side")).alias("rating"))


def top_current(hist: DataFrame, n: int) -> DataFrame:
    return latest_ratings(hist).orderBy(F.col("rating").desc(), "player").limit(n)


def top_peaks(hist: DataFrame, n: int) -> DataFrame:
    return hist.groupBy("player").agg(F.max("post").alias("peak")).orderBy(F.col("peak").desc(), "player").limit(n)


def player_rows(hist: DataFrame, player: str, n: int) -> DataFrame:
    return hist.filter(F.col("player") == player).orderBy(F.col("day").desc(), F.col("seq").desc(), "side").limit(n)


def players(contests: DataFrame) -> DataFrame:
    return contests.select(F.explode(F.array("player", "opponent")).alias("player")).distinct()


def player_totals(contests: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Contests, first and last day of every player."""
    return (
        contests.select(*keys, "day", F.explode(F.array("player", "opponent")).alias("player"))
        .groupBy(*keys, "player")
        .agg(F.count(F.lit(1)).alias("bouts"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    )


def as_of(
    probes: DataFrame,
    known: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    known_order: list[str],
    slice_of=month_slice,
) -> DataFrame:
    """For each probe (``keys``, ``day``) the ``values`` of the last ``known`` row on a strictly earlier day.

    Probes and known rows are merged into one ordered stream per key; a probe sorts before the rows of its own day, so a running
    maximum of (day, order, values) is the as-of row. Hot keys are split by month (see ``prefix.running``).
    """
    payload = F.struct(F.col("day").alias("_d"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(known_order)], *[v.alias(n) for n, v in values.items()])
    cols = probes.columns
    a = probes.select(*keys, "day", F.struct(*cols).alias("_probe"))
    b = known.select(*keys, "day", payload.alias("_known"))
    stream = a.unionByName(b, allowMissingColumns=True).withColumn("_kind", F.col("_known").isNotNull().cast("int"))
    # rows of one day and kind may come in any order, so a crowded day is cut by a hash
    spread = F.pmod(F.xxhash64("_probe", "_known"), F.lit(1 << 30)) + F.col("_kind") * (1 << 30)
    seen = running(stream, keys, slice_of("day"), ["day", "_kind"], {"_last": ("max", F.col("_known"))}, fine=place("day", spread))
    found = seen.filter(F.col("_kind") == 0)
    return found.select(*[F.col(f"_probe.{c}").alias(c) for c in cols], *[F.col(f"_last.{n}").alias(n) for n in values])


def layoff_days(contests: DataFrame) -> DataFrame:
    """Days since each side's last contest on a strictly earlier day; null on a debut."""
    days = contests.select("day", F.explode(F.array("player", "opponent")).alias("who")).distinct()
    seen = running(days, ["who"], month_slice("day"), ["day"], {"prev": ("max", F.col("day"))}, inclusive=False)
    gaps = seen.select("who", "day", F.datediff("day", "prev").alias("layoff"))
    out = contests
    for side, name in (("player", "layoff"), ("opponent", "opp_layoff")):
        out = out.join(gaps.select(F.col("who").alias(side), "day", F.col("layoff").alias(name)), [side, "day"], "left")
    return out


def match_names(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Match ``names.name`` to ``roster.player``: equal folded text first, else equal first and last token (two tokens each).

    Ties go to the smallest roster name, taken by aggregation before the join, so no pair list is built.
    Unmatched names keep their own spelling.
    """
    fold = lambda c: S.fold_name(c)

    def ends(folded: Column) -> Column:
        parts = F.split(folded, " ")
        return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1)))

    known = roster.select("player", fold("player").alias("_folded"))
    exact = known.groupBy("_folded").agg(F.min("player").alias("_exact"))
    loose = known.withColumn("_ends", ends(F.col("_folded"))).filter(F.col("_ends").isNotNull()).groupBy("_ends").agg(F.min("player").alias("_loose"))
    asked = names.select("name").distinct().withColumn("_folded", fold("name")).withColumn("_ends", ends(F.col("_folded")))
    return (
        asked.join(exact, "_folded", "left")
        .join(loose, "_ends", "left")
        .select(
            "name",
            F.coalesce("_exact", "_loose", "name").alias("matched"),
            F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "ends").otherwise("none").alias("how"),
        )
    )


def rename_by_match(contests: DataFrame, roster: DataFrame) -> DataFrame:
    """Replace both names of a holdout table by their matches in the roster."""
    table = match_names(contests.select(F.explode(F.array("player", "opponent")).alias("name")), roster)
    out = contests
    for side in ("player", "opponent"):
        m = table.select(F.col("name").alias(side), F.col("matched").alias(f"{side}_matched"))
        out = out.join(m, side, "left")
    return out.withColumns({"player_given": F.col("player"), "opponent_given": F.col("opponent")}).withColumns(
        {"player": F.col("player_matched"), "opponent": F.col("opponent_matched")}
    ).drop("player_matched", "opponent_matched")
