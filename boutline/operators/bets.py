"""From rated contests to predictions and one-unit bets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .history import player_totals


def decided(df: DataFrame) -> DataFrame:
    """Contests with a winner and a date; draws still move ratings but are neither predicted nor bet on."""
    return df.filter(F.col("result").isin(0.0, 1.0) & ~F.col("is_draw") & F.col("day").isNotNull())


def first_per_pair(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First row of each unordered pair and day. Spark limits each group map-side before the shuffle."""
    w = W.partitionBy(*keys, F.least("player", "opponent"), F.greatest("player", "opponent"), "day").orderBy("seq")
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def with_first_days(df: DataFrame, source: DataFrame, keys: list[str] = ()) -> DataFrame:
    firsts = player_totals(source, keys)
    out = df
    for side, name in (("player", "first_day"), ("opponent", "opp_first_day")):
        out = out.join(firsts.select(*keys, F.col("player").alias(side), F.col("first_day").alias(name)), [*keys, side], "left")
    return out


def with_prior_history(df: DataFrame, source: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Keep contests where both sides already had a contest on an earlier day."""
    joined = with_first_days(df, source, keys)
    return joined.filter((F.col("day") > F.col("first_day")) & (F.col("day") > F.col("opp_first_day"))).drop("first_day", "opp_first_day")


def within_lookback(df: DataFrame, days: int | None, source: DataFrame | None = None) -> DataFrame:
    """Rows later than the last day minus ``days``; no limit for zero or None. The last day is read from ``source`` where
    that is cheaper than ``df`` (the unrated contests of a rated table)."""
    if not days:
        return df
    cut = (df if source is None else source).agg(F.date_sub(F.max("day"), days)).scalar()
    return df.filter(F.col("day") > cut)


def predictions(rated: DataFrame, source: DataFrame) -> DataFrame:
    """Winner predicted as the side with the higher rating before the contest."""
    kept = with_prior_history(decided(rated).filter(F.col("pre") != F.col("opp_pre")), source)
    picked = (F.col("pre") > F.col("opp_pre")).cast("int")
    return kept.withColumn("picked", picked).withColumn("correct", (picked == F.col("result")).cast("int"))


def scored(rated: DataFrame, source: DataFrame, scale: float = S.RATING_SCALE, dedup: bool = False, keys: list[str] = ()) -> DataFrame:
    """Predictions with the player's winning probability. The scale stays 400 whatever the scan used."""
    p = predictions(first_per_pair(decided(rated), keys) if dedup else rated, source)
    return p.withColumns({"prob": S.expected_score("pre", "opp_pre", scale), "diff": F.col("pre") - F.col("opp_pre")})


def price_table(odds: DataFrame, price: str = "american") -> DataFrame:
    """One price per (player, opponent, day): the last non-null row by ``odds_seq``."""
    return (
        odds.filter(F.col(price).isNotNull())
        .groupBy("player", "opponent", "day")
        .agg(F.max_by(price, "odds_seq").alias("american"))
    )


def price_table_from_contests(contests: DataFrame, price: str = "american") -> DataFrame:
    """Prices carried by the contests themselves: a direct row wins over the mirrored one, last over first."""
    rows = contests.filter(F.col(price).isNotNull()).select(
        "day",
        F.explode(
            F.array(
                F.struct(F.col("player"), F.col("opponent"), F.lit(True).alias("direct"), F.col(price).alias("p"), F.col("seq")),
                F.struct(F.col("opponent").alias("player"), F.col("player").alias("opponent"), F.lit(False).alias("direct"), F.col(price).alias("p"), F.col("seq")),
            )
        ).alias("r"),
    ).select("day", "r.*")
    return rows.groupBy("player", "opponent", "day").agg(
        F.coalesce(F.max_by(F.when(F.col("direct"), F.col("p")), F.when(F.col("direct"), F.col("seq"))), F.min_by(F.when(~F.col("direct"), F.col("p")), F.when(~F.col("direct"), F.col("seq")))).alias("american")
    )


def attach_prices(picks: DataFrame, prices: DataFrame, fallback: str = "strict") -> DataFrame:
    """Price of the chosen side. ``strict``: its own row; ``mirror``: else the other side's row with the same number;
    ``both``: the player's row must exist as well, whichever side is chosen."""
    own = prices.select(F.col("player").alias("bet_on"), F.col("opponent").alias("bet_against"), "day", F.col("american").alias("_own"))
    out = picks.join(own, ["bet_on", "bet_against", "day"], "inner" if fallback == "strict" else "left")
    price = F.col("_own")
    if fallback == "mirror":
        other = prices.select(F.col("opponent").alias("bet_on"), F.col("player").alias("bet_against"), "day", F.col("american").alias("_other"))
        out = out.join(other, ["bet_on", "bet_against", "day"], "left")
        price = F.coalesce("_own", "_other")
    elif fallback == "both":
        listed = prices.select("player", "opponent", "day", F.lit(True).alias("_listed"))
        out = out.join(listed, ["player", "opponent", "day"], "left_semi")
    elif fallback != "strict":
        raise ValueError(f"unknown price fallback {fallback!r}")
    return out.withColumn("american", price).drop("_own", "_other").filter(F.col("american").isNotNull())


def both_prices(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the prices of both sides' own rows, ``_price`` and ``_opp_price``, for contests whose pick is not known yet."""
    own = prices.select("player", "opponent", "day", F.col("american").alias("_price"))
    other = prices.select(F.col("opponent").alias("player"), F.col("player").alias("opponent"), "day", F.col("american").alias("_opp_price"))
    on = ["player", "opponent", "day"]
    return df.join(own, on, "left").join(other, on, "left")


def picks(df: DataFrame) -> DataFrame:
    """The side with the higher rating; equal ratings give no pick."""
    up = F.col("pre") > F.col("opp_pre")
    diff = F.abs(F.col("pre") - F.col("opp_pre"))
    return df.filter(F.col("pre") != F.col("opp_pre")).withColumns(
        {
            "bet_on": F.when(up, F.col("player")).otherwise(F.col("opponent")),
            "bet_against": F.when(up, F.col("opponent")).otherwise(F.col("player")),
            "bet_won": (F.when(up, F.col("result") == 1.0).otherwise(F.col("result") == 0.0)).cast("int"),
            "diff": diff,
            "prob": S.expected_score(F.lit(0.0), -diff),
        }
    )


def settle(priced: DataFrame, stake: float = 1.0) -> DataFrame:
    """Decimal price, payout and profit; rows whose price is unusable are dropped."""
    d = S.decimal_odds("american")
    won = F.col("bet_won") == 1
    return (
        priced.withColumn("decimal", d)
        .filter(F.col("decimal").isNotNull())
        .withColumns(
            {
                "stake": F.lit(stake),
                "payout": F.when(won, F.col("decimal") * stake).otherwise(0.0),
                "profit": F.when(won, (F.col("decimal") - 1.0) * stake).otherwise(-stake),
            }
        )
    )


def bet_records(
    rated: DataFrame,
    source: DataFrame,
    odds: DataFrame,
    keys: list[str] = (),
    lookback: int | None = None,
    dedup: str = "early",
    fallback: str = "strict",
) -> DataFrame:
    """Bets on the higher-rated side of every eligible contest.

    With ``dedup='early'`` the first row of a pair and day hides its mirror even if it is rejected later; ``'late'`` picks the first
    row among the eligible ones.
    """
    if dedup not in ("early", "late"):
        raise ValueError(f"unknown dedup {dedup!r}")
    df = decided(within_lookback(rated, lookback, source))
    if dedup == "early":
        df = first_per_pair(df, keys)
    df = with_prior_history(picks(df), source)
    if dedup == "late":
        df = first_per_pair(df, keys)
    return settle(attach_prices(df, price_table(odds), fallback))


def with_counts_filter(rated_with_bouts: DataFrame) -> DataFrame:
    """Eligibility by bout counts instead of dates: both sides have at least one earlier contest."""
    return decided(rated_with_bouts).filter((F.col("bouts") >= 1) & (F.col("opp_bouts") >= 1) & (F.col("pre") != F.col("opp_pre")))


def vector_bets(faced: DataFrame) -> DataFrame:
    """Bets per candidate on contests that carry the vectors ``rating`` and ``opp_rating`` and ``both_prices``, with the other side's row as a
    fallback. Nothing is joined per candidate."""
    kept = [c for c in faced.columns if c not in ("rating", "opp_rating")]
    each = faced.select(*kept, F.posexplode(F.arrays_zip(F.col("rating").alias("pre"), F.col("opp_rating").alias("opp_pre"))).alias("candidate_id", "_v"))
    picked = picks(each.select("*", "_v.pre", "_v.opp_pre").drop("_v"))
    price = F.when(F.col("pre") > F.col("opp_pre"), F.coalesce("_price", "_opp_price")).otherwise(F.coalesce("_opp_price", "_price"))
    return settle(picked.withColumn("american", price).filter(F.col("american").isNotNull())).drop("_price", "_opp_price")
