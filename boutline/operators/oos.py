"""Out-of-sample use of frozen ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import materialize
from . import history as H
from .bets import attach_prices, decided, first_per_pair, picks, price_table, settle
from .ratings import both_sides, rate_vectors, sides, with_candidates


def ratings_as_of(contests: DataFrame, hist: DataFrame, keys: list[str] = (), day: str = "day") -> DataFrame:
    """Add ``rating`` and ``opp_rating``: each side's rating after its last contest strictly before ``day``; null if none."""
    keys = list(keys)
    probes = sides(contests.select(*keys, "seq", F.col(day).alias("day"), "player", "opponent")).select(*keys, "seq", "day", "side", F.col("who").alias("player"))
    # both branches of the running maximum read the history, so the scan behind it is written once
    hist = materialize(hist.select(*keys, "player", "day", "seq", "side", "post"))
    found = H.as_of(probes, hist, [*keys, "player"], {"rating": F.col("post")}, ["seq", "side"])
    return both_sides(contests, found, ["rating"], on=(*keys, "seq"))


def latest_for_both(contests: DataFrame, latest: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Add ``rating``/``opp_rating`` from a (keys, player, rating) table."""
    out = contests
    for side, name in (("player", "rating"), ("opponent", "opp_rating")):
        out = out.join(latest.select(*keys, F.col("player").alias(side), F.col("rating").alias(name)), [*keys, side], "left")
    return out


def oos_bets(rated: DataFrame, trained: DataFrame, holdout: DataFrame, odds: DataFrame, candidates: list[dict]) -> DataFrame:
    """Bets on a holdout with ratings frozen at the end of training: names matched, unknown players at the base rating, no history
    rule, equal ratings skipped, price of the other side's row as a fallback."""
    keys = ["candidate_id"]
    cards = first_per_pair(decided(holdout))
    matched = with_candidates(H.rename_by_match(cards, H.players(trained)), candidates).drop("c")
    latest = H.latest_ratings(H.history(rated, keys), keys)
    base = F.lit(S.BASE_RATING)
    faced = latest_for_both(matched, latest, keys).withColumns({"pre": F.coalesce("rating", base), "opp_pre": F.coalesce("opp_rating", base)})
    return settle(attach_prices(picks(faced), price_table(odds), "mirror"))


def oos_roi(bets: DataFrame, keys: list[str] = ("candidate_id",)) -> DataFrame:
    return bets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"),
        F.sum("stake").alias("wagered"),
        F.sum("profit").alias("profit"),
        F.sum("bet_won").alias("wins"),
        F.avg(F.col("bet_won").cast("double")).alias("accuracy"),
        (F.sum("profit") / F.sum("stake") * 100.0).alias("roi"),
    )


def oos_predictions(rated: DataFrame, trained: DataFrame, holdout: DataFrame, candidates: list[dict], min_bouts: int = 1, match: bool = True) -> DataFrame:
    """Holdout predictions with as-of ratings; both sides need ``min_bouts`` training contests. A tie predicts the opponent."""
    keys = ["candidate_id"]
    known = decided(holdout)
    if match:
        known = H.rename_by_match(known, H.players(trained))
    if min_bouts:
        totals = H.player_totals(trained)
        for side in ("player", "opponent"):
            enough = totals.filter(F.col("bouts") >= min_bouts).select(F.col("player").alias(side))
            known = known.join(enough, side, "left_semi")
    cards = with_candidates(known, candidates).drop("c")
    faced = ratings_as_of(cards, H.history(rated, keys), keys)
    base = F.lit(S.BASE_RATING)
    r1, r2 = F.coalesce("rating", base), F.coalesce("opp_rating", base)
    return faced.withColumns({"rating": r1, "opp_rating": r2}).withColumn("picked", (F.col("rating") > F.col("opp_rating")).cast("int")).withColumn(
        "correct", (F.col("picked") == F.col("result")).cast("int")
    )


def frozen_at(trained: DataFrame, holdout: DataFrame, day: str = "day") -> DataFrame:
    """For each holdout contest and side the training contest (``at_seq``, ``at_side``) that its rating as of ``day`` comes from; none for the unknown.
    No rating is needed for this."""
    probes = sides(holdout.select("seq", F.col(day).alias("day"), "player", "opponent")).select("seq", "day", "side", F.col("who").alias("player"))
    played = trained.filter(F.col("result").isNotNull() | F.col("is_draw"))
    known = sides(played.select("seq", "day", "player", "opponent")).select("seq", "day", "side", F.col("who").alias("player"))
    found = H.as_of(probes, materialize(known), ["player"], {"at_seq": F.col("seq"), "at_side": F.col("side")}, ["seq", "side"])
    return found.filter(F.col("at_seq").isNotNull()).select("seq", "side", "at_seq", "at_side")


def frozen_last(trained: DataFrame, holdout: DataFrame) -> DataFrame:
    """As ``frozen_at``, with each player's last training contest whatever the day."""
    played = trained.filter(F.col("result").isNotNull() | F.col("is_draw"))
    last = sides(played.select("seq", "day", "player", "opponent")).groupBy("who").agg(F.max(F.struct("day", "seq", "side")).alias("_e"))
    each = sides(holdout.select("seq", "player", "opponent")).select("seq", "side", "who")
    return each.join(last, "who").select("seq", "side", F.col("_e.seq").alias("at_seq"), F.col("_e.side").alias("at_side"))


def flag_frozen(trained: DataFrame, frozen: DataFrame) -> DataFrame:
    """Training contests with ``_own`` and ``_opp``: whether a holdout contest needs the rating of that side after it."""
    need = frozen.groupBy(F.col("at_seq").alias("seq")).agg(F.max(F.col("at_side") == 0).alias("_own"), F.max(F.col("at_side") == 1).alias("_opp"))
    return trained.join(need, "seq", "left").na.fill(False, ["_own", "_opp"])


FROZEN = {"post": "_own", "opp_post": "_opp"}  # outputs of a scan that a holdout needs


def oos_grid(trained: DataFrame, holdout: DataFrame, candidates: list[dict], match: bool = True) -> DataFrame:
    """``oos_predictions`` for many candidates: each holdout contest looks up one vector of frozen ratings per side, the scan writes only those
    vectors, and only the comparison is made per candidate."""
    known = decided(holdout)
    if match:
        known = H.rename_by_match(known, H.players(trained))
    known = materialize(known.select("seq", "day", "player", "opponent", "result"))
    frozen = materialize(frozen_at(trained, known))
    vectors = rate_vectors(flag_frozen(trained, frozen), candidates, carry=["_own", "_opp"], emit=FROZEN, store=False)
    return compare_frozen(known, frozen, vectors, len(candidates))


def with_frozen(known: DataFrame, frozen: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``rating`` and ``opp_rating``, the frozen vectors of both sides, from the vectors of ``FROZEN``; null for the unknown."""
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("at_side"), F.col(c).alias("vector")) for s, c in enumerate(FROZEN)])).alias("e")
    ends = materialize(vectors.select(F.col("seq").alias("at_seq"), ends).select("at_seq", "e.*").filter(F.col("vector").isNotNull()))
    faced = known
    for side, name in enumerate(("rating", "opp_rating")):
        own = frozen.filter(F.col("side") == side).join(ends, ["at_seq", "at_side"]).select("seq", F.col("vector").alias(name))
        faced = faced.join(own, "seq", "left")
    return faced


def compare_frozen(known: DataFrame, frozen: DataFrame, vectors: DataFrame, candidates: int) -> DataFrame:
    """Predictions per candidate from the vectors of ``FROZEN``."""
    faced = with_frozen(known.select("seq", "result"), frozen, vectors)
    base = F.array_repeat(F.lit(S.BASE_RATING), candidates)
    both = F.arrays_zip(F.coalesce("rating", base).alias("rating"), F.coalesce("opp_rating", base).alias("opp_rating"))
    rows = faced.select("seq", "result", F.posexplode(both).alias("candidate_id", "_v")).select("candidate_id", "seq", "result", "_v.rating", "_v.opp_rating")
    picked = (F.col("rating") > F.col("opp_rating")).cast("int")
    return rows.withColumn("picked", picked).withColumn("correct", (picked == F.col("result")).cast("int"))


def oos_accuracy(preds: DataFrame, gap: float | None = None, keys: list[str] = ("candidate_id",)) -> DataFrame:
    wide = F.abs(F.col("rating") - F.col("opp_rating")) >= (gap or 0.0)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("correct").alias("accuracy"),
        F.count_if(wide).alias("gap_n"),
        F.avg(F.when(wide, F.col("correct"))).alias("gap_accuracy"),
    )
