"""Documents of a run: one nested JSON per configuration and a master document over all of them.

Every part (summary, curve, breakdowns, deciles, ...) is a small table by candidate. The parts are stacked, each in its own struct column,
and one grouped aggregation makes the document, so there is one shuffle of some hundred rows per candidate and no chain of joins.
Numbers that are not finite are null; a part without rows is null or an empty list, and ``warnings`` says what is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fitness as FIT
from ..functions import scalar as S
from ..session import materialize
from ..sources.sinks import finite
from . import bets as K
from . import consistency as C
from . import metrics as M
from .oos import FROZEN, compare_frozen, flag_frozen, frozen_at, oos_accuracy
from .ratings import bout_counts, rate_vectors
from .scan import unfold
from .sweep import KEYS, flagged_bets, train_val_side

FEW_BETS = 30


def _packed(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    cols = [finite(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in fields]
    return df.select(*KEYS, F.struct(*cols).alias(name))


def assembled(single: dict[str, DataFrame], many: dict[str, DataFrame]) -> DataFrame:
    """One row per candidate: a struct for every table of ``single`` and an array of structs, ordered by their fields, for every table of ``many``."""
    parts = [_packed(df, n, [c for c in df.columns if c not in KEYS]) for n, df in (single | many).items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*KEYS).agg(*[F.any_value(n, F.lit(True)).alias(n) for n in single], *[F.array_sort(F.collect_list(n)).alias(n) for n in many])


def _window_rois(bets: DataFrame, contests: DataFrame, lookback: int, validation: float) -> dict[str, DataFrame]:
    sided = train_val_side(bets, contests, lookback, validation)
    return {s: M.roi_summary(sided.filter(F.col("side") == s), KEYS).select(*KEYS, F.col("roi").alias("roi_percent"), F.col("bets").alias("num_bets")) for s in ("train", "val")}


def _counted_vectors(contests: DataFrame, odds: DataFrame, candidates: list[dict], decay: bool, moves: bool, frozen: DataFrame | None = None) -> DataFrame:
    """Contests that are predicted, with what the metrics need of them and the vectors ``pre`` and ``opp_pre``; ``_bet`` as in ``flag_bets``. History,
    repeated pairs, prices and bout counts depend on the contest alone and are joined once per contest; rows per candidate are never written. With
    ``frozen`` also the vectors of ``FROZEN``."""
    thin = contests.select("seq", "day", "player", "opponent", "result", "is_draw")
    pair = W.partitionBy(F.least("player", "opponent"), F.greatest("player", "opponent"), "day").orderBy("seq")
    open_ = K.with_prior_history(K.decided(thin).withColumn("_nth", F.row_number().over(pair)), contests)
    bet = (F.col("_nth") == 1) & (F.col("_price").isNotNull() | F.col("_opp_price").isNotNull())
    flags = K.both_prices(open_, K.price_table(odds)).select("seq", F.lit(True).alias("_counted"), bet.alias("_bet"), "_price", "_opp_price")
    flags = flags.join(bout_counts(thin).select("seq", "bouts", "opp_bouts"), "seq")
    flagged = contests.drop("played_at", "win", "loss").withColumn("method", S.method_label_by_ones()).join(flags, "seq", "left")
    flagged = flagged.na.fill(False, ["_counted", "_bet"])
    flagged = materialize(flagged if frozen is None else flag_frozen(flagged, frozen))
    carry = ["result", "method", "bouts", "opp_bouts", "_bet", "_price", "_opp_price"]
    emit = {"pre": "_counted", "opp_pre": "_counted"}
    flags = ["_counted", *(FROZEN.values() if frozen is not None else ())]
    emit |= FROZEN if frozen is not None else {}
    return materialize(rate_vectors(flagged, candidates, decay, moves, [*carry, *flags], emit=emit, store=False).drop(*flags))


def _scored(vectors: DataFrame) -> DataFrame:
    """``scored`` of every candidate on ``_counted_vectors``."""
    rows = unfold(vectors.drop(*FROZEN), carry=["result", "method", "bouts", "opp_bouts"]).filter(F.col("pre") != F.col("opp_pre"))
    return rows.withColumns({"prob": S.expected_score("pre", "opp_pre", S.RATING_SCALE), "diff": F.col("pre") - F.col("opp_pre")})


def run_documents(
    contests: DataFrame,
    odds: DataFrame,
    configs: list[dict],
    oos: DataFrame | None = None,
    evolution: DataFrame | None = None,
    run: dict | None = None,
    weights: dict | None = None,
    lookback: int = 730,
    validation: float = 0.5,
    decay: bool = False,
    moves: bool = False,
    holdout: DataFrame | None = None,
    holdout_days: int | None = None,
) -> DataFrame:
    """(candidate_id, config, document, summary...) for every configuration (``{"name", "params"}``), evaluated by one scan.

    ``oos`` holds out-of-sample columns by candidate; with ``holdout`` it is the accuracy on that table, of ratings frozen ``holdout_days`` before the
    last day, from the same scan (a rating never depends on later contests). ``evolution`` has rows of (candidate_id, generation, ...); both may be absent. ``best_fitness``
    weighs by ``weights``; without any it is the ROI.
    """
    spark = contests.sparkSession
    frozen = None
    if holdout is not None:
        known = materialize(K.decided(holdout).select("seq", "day", "player", "opponent", "result"))
        train = contests.filter(F.col("day") <= contests.agg(F.date_sub(F.max("day"), holdout_days or 0)).scalar())
        frozen = materialize(frozen_at(train, known))
    vectors = _counted_vectors(contests, odds, [c["params"] for c in configs], decay, moves, frozen)
    if holdout is not None:
        oos = oos_accuracy(compare_frozen(known, frozen, vectors, len(configs))).select(*KEYS, "n", "accuracy")
    bets, scored = flagged_bets(vectors), _scored(vectors)
    buckets = materialize(C.by_bucket(scored, {**C.dimensions(), "method": F.col("method")}, KEYS))
    about = [(i, c["name"], {k: float(v) for k, v in c["params"].items() if not isinstance(v, str)}) for i, c in enumerate(configs)]
    windows = _window_rois(bets, contests, lookback, validation)
    roi = M.roi_extended(bets, KEYS).withColumn("roi", F.try_divide(F.col("profit"), F.col("wagered")) * 100.0)
    single = {
        "about": spark.createDataFrame(about, "candidate_id int, config string, params map<string,double>"),
        "bet": roi.select(*KEYS, "roi", "trend", "sharpe", "win_rate", "bets", "wagered", "profit"),
        "prob": M.probability_metrics(scored, KEYS),
        "ece": M.expected_calibration_error(scored, KEYS),
        "line": M.calibration_line(scored, KEYS).select(*KEYS, "slope", "intercept"),
        "auc": M.auc(scored, KEYS).select(*KEYS, "auc"),
        "cons": C.overall(C.spread(buckets, KEYS), KEYS),
        "fall": M.deepest_drawdown(bets, KEYS),
        **windows,
    }
    many = {
        "curve": M.calibration_bins(scored, KEYS).select(*KEYS, "bin", "mean_prob", "win_rate", "n"),
        "buckets": buckets.select(*KEYS, "dimension", "bucket", "n", "accuracy", "brier"),
        "deciles": M.roi_by_decile(bets, KEYS).select(*KEYS, "bin", "decile", "bets", "roi", "win_rate", "wagered"),
    }
    if oos is not None:
        single["oos"] = oos
    if evolution is not None:
        many["evolution"] = evolution
    d = assembled(single, many)
    fitness = FIT.search_fitness(F.coalesce("bet.roi", F.lit(0.0)), F.col("bet.trend"), F.col("bet.sharpe"), F.col("ece.ece"), F.col("cons.consistency_variance"), F.col("auc.auc"), weights)
    d = d.withColumns({"fitness": finite(fitness), "bets": F.coalesce("bet.bets", F.lit(0))})
    none = F.lit(None)
    summary = F.struct(
        F.col("bet.roi").alias("roi_percent"), F.col("prob.accuracy").alias("accuracy"), F.col("bet.sharpe").alias("sharpe_ratio"), F.col("bet.win_rate").alias("win_rate"),
        F.col("bets").alias("num_bets"), F.col("ece.ece").alias("ece"), F.col("prob.brier").alias("brier_score"), F.col("prob.log_loss").alias("log_loss"),
        F.col("line.slope").alias("calibration_slope"), F.col("auc.auc").alias("auc_roc"), F.col("cons.consistency_variance").alias("consistency_variance"), F.col("fall.max_drawdown").alias("max_drawdown"),
    )
    curve = F.transform("curve", lambda b: F.struct(F.concat(b["bin"] * 10, F.lit("-"), (b["bin"] + 1) * 10, F.lit("%")).alias("range"), b["mean_prob"].alias("predicted"), b["win_rate"].alias("actual"), b["n"].alias("count")))
    body = F.struct(
        F.col("about.config").alias("config_name"),
        F.struct(*[F.lit(v).alias(k) for k, v in (run or {}).items()], F.lit(len(configs)).alias("configurations"), F.lit(lookback).alias("lookback_days")).alias("run_info"),
        F.col("about.params").alias("best_params"),
        F.col("fitness").alias("best_fitness"),
        F.struct("train", "val", (F.col("oos") if oos is not None else none).alias("oos")).alias("best_metrics"),
        summary.alias("summary"),
        curve.alias("calibration_curve"),
        F.struct(*[_breakdown(x).alias(f"by_{x}") for x in C.dimensions()]).alias("consistency_breakdown"),
        F.transform("deciles", lambda x: x.dropFields("bin")).alias("roi_by_decile"),
        (F.col("evolution") if evolution is not None else none).alias("evolution"),
        F.struct("bet", "prob", "ece", "line", "auc", "cons", "fall").alias("comprehensive_metrics"),
        _warnings().alias("warnings"),
    )
    return d.select(*KEYS, F.col("about.config").alias("config"), F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def _breakdown(dimension: str) -> Column:
    return F.transform(F.filter("buckets", lambda b: b["dimension"] == dimension), lambda b: b.dropFields("dimension"))


def _warnings() -> Column:
    tests = {
        "no bets": F.col("bets") == 0,
        "few bets": (F.col("bets") > 0) & (F.col("bets") < FEW_BETS),
        "no predictions": F.col("prob").isNull(),
        "one class only": F.col("prob").isNotNull() & F.col("auc.auc").isNull(),
        "no Sharpe ratio": (F.col("bets") > 0) & F.col("bet.sharpe").isNull(),
    }
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def master_document(docs: DataFrame, run: dict | None = None) -> DataFrame:
    """One row: all configurations with parameters and metrics, best ROI first, nulls last (one entry per configuration, a short list)."""
    part = lambda path: F.get_json_object("document", path)
    names = ("roi_percent", "accuracy", "num_bets", "win_rate", "sharpe_ratio")
    entry = F.struct(
        F.col("config").alias("config_name"),
        F.from_json(part("$.best_params"), "map<string,double>").alias("parameters"),
        F.struct(*[part(f"$.summary.{n}").cast("double").alias(n) for n in names], part("$.best_metrics.oos.accuracy").cast("double").alias("oos_accuracy")).alias("metrics"),
        (F.coalesce(part("$.summary.num_bets").cast("long"), F.lit(0)) > 0).alias("success"),
        F.row_number().over(W.orderBy(part("$.summary.roi_percent").cast("double").desc_nulls_last(), *KEYS)).alias("rank"),
    )
    ranked = F.array_sort(F.collect_list("e"), lambda a, b: a["rank"] - b["rank"])
    head = F.struct(*[F.lit(v).alias(k) for k, v in (run or {}).items()], F.count(F.lit(1)).alias("configurations"))
    return docs.select(entry.alias("e")).agg(F.to_json(F.struct(head.alias("run_info"), ranked.alias("configurations")), {"ignoreNullFields": "false"}).alias("document"))
