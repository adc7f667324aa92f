"""Many-evaluation jobs: a list of parameter sets is evaluated by one keyed Spark job, whatever its length."""

from __future__ import annotations

import random

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fitness as FIT
from ..functions import scalar as S
from ..session import materialize
from ..sources.contests import FLAGS
from . import bets as K
from . import consistency as C
from . import metrics as M
from .history import players, rename_by_match
from .oos import FROZEN, compare_frozen, flag_frozen, frozen_at, frozen_last, oos_accuracy, with_frozen
from .ratings import bout_counts, rate, rate_vectors
from .scan import unfold

KEYS = ["candidate_id"]

# Search bounds of every parameter (low, high).
BOUNDS = {"k": (10.0, 500.0), "w_ko": (1.0, 2.0), "w_sub": (1.0, 2.0), "w_udec": (0.8, 1.2), "w_sdec": (0.5, 1.1), "w_mdec": (0.7, 1.2)}
DECAY_BOUNDS = {"decay_rate": (0.0, 0.01), "min_days": (0, 365)}
PHASE_BOUNDS = {"quick_days": (7.0, 89.0), "quick_bump": (1.0, 1.15), "decay_days": (91.0, 365.0), "phase_rate": (0.0005, 0.015)}
MOVE_BOUNDS = {"up_penalty": (0.80, 0.98), "up_bonus": (1.05, 1.25)}
SCALE_BOUNDS = {"scale": (200.0, 800.0)}
WHOLE = ("min_days", "quick_days", "decay_days")


def k_grid(low: int = 10, high: int = 500, step: int = 10) -> list[dict]:
    """Every K with and without method weights; the order decides ties."""
    return [{"k": float(k), "use_method": float(m)} for m in (1, 0) for k in range(low, high, step)]


def flag_counted(contests: DataFrame, cutoff: Column, moment: Column) -> DataFrame:
    """Contests with ``_counted`` (decided, both sides seen on an earlier day) and ``late`` (after the cutoff). No rating is needed for this."""
    counted = K.with_prior_history(K.decided(contests.select("seq", "day", "player", "opponent", "result", "is_draw")), contests).select("seq", F.lit(True).alias("_counted"))
    return materialize(contests.withColumn("late", moment > cutoff).join(counted, "seq", "left").na.fill(False, ["_counted"]))


def compare_counted(vectors: DataFrame) -> DataFrame:
    """Accuracy overall and late per candidate from the ``order`` of the counted contests."""
    rows = vectors.filter(F.col("order").isNotNull()).select("result", "late", F.posexplode("order").alias("candidate_id", "_o")).filter(F.col("_o") != 0)
    rows = rows.withColumn("correct", ((F.col("_o") > 0).cast("int") == F.col("result")).cast("int"))
    late = F.col("late")
    return rows.groupBy(*KEYS).agg(F.avg("correct").alias("accuracy"), F.avg(F.when(late, F.col("correct"))).alias("later_accuracy"), F.count_if(late).alias("later_rows"))


def grid_accuracy(contests: DataFrame, candidates: list[dict], cutoff: Column, moment: Column) -> DataFrame:
    """Accuracy overall and after a cutoff of ``moment`` for each candidate. Which contests count is decided once per contest and before the
    scan, which returns one sign per candidate for those."""
    flagged = flag_counted(contests, cutoff, moment)
    return compare_counted(rate_vectors(flagged, candidates, carry=["result", "late", "_counted"], emit={"order": "_counted"}, store=False))


def evaluate_accuracy(contests: DataFrame, candidates: list[dict], cutoff: Column, moment: Column, holdout: DataFrame | None = None) -> DataFrame:
    """Accuracy after the cutoff as ``fitness`` and, with a holdout, the accuracy of frozen ratings on it. One scan rates all candidates for
    both; a candidate without a later prediction has a fitness of zero."""
    flagged, carry, emit = flag_counted(contests, cutoff, moment), ["result", "late", "_counted"], {"order": "_counted"}
    if holdout is not None:
        known = materialize(K.decided(holdout).select("seq", "day", "player", "opponent", "result"))
        frozen = materialize(frozen_at(contests, known))
        flagged, carry, emit = flag_frozen(flagged, frozen), [*carry, "_own", "_opp"], {**emit, **FROZEN}
    vectors = materialize(rate_vectors(flagged, candidates, carry=carry, emit=emit, store=False))
    out = contests.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("candidate_id")).join(compare_counted(vectors), KEYS, "left")
    out = out.select(*KEYS, F.coalesce("later_accuracy", F.lit(0.0)).alias("fitness"), "accuracy")
    if holdout is None:
        return out.withColumn("oos_accuracy", F.lit(None).cast("double"))
    outside = oos_accuracy(compare_frozen(known, frozen, vectors, len(candidates)))
    return out.join(outside.select(*KEYS, F.col("accuracy").alias("oos_accuracy")), KEYS, "left")


def best_of(df: DataFrame, score: str, groups: list[str] = ()) -> DataFrame:
    """Mark the best row; the first of equals wins. The candidate list is short, so the window is too."""
    w = W.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), "candidate_id")
    return df.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))


def evaluate(contests: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int | None = None, decay: bool = False, moves: bool = False) -> DataFrame:
    """ROI with its daily trend and risk plus probability metrics for each candidate; missing bets give an ROI of zero."""
    rated = materialize(rate(contests, candidates, decay=decay, moves=moves, carry=["result", "is_draw", "played_at"]))
    bets = K.bet_records(rated, contests, odds, KEYS, lookback)
    roi = M.roi_extended(bets, KEYS).withColumn("roi", F.try_divide(F.col("profit"), F.col("wagered")) * 100.0)
    scored = K.scored(K.within_lookback(rated, lookback, contests), contests, dedup=True, keys=KEYS)
    probs = M.probability_metrics(scored, KEYS)
    every = rated.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("candidate_id"))
    return (
        every.join(roi, "candidate_id", "left")
        .join(probs, "candidate_id", "left")
        .withColumns({"roi": F.coalesce("roi", F.lit(0.0)), "bets": F.coalesce("bets", F.lit(0))})
    )


def flag_bets(contests: DataFrame, odds: DataFrame, lookback: int | None = None) -> DataFrame:
    """Contests with ``_bet`` (``bet_records`` would bet on it if the ratings differ) and the prices of both sides. No rating is needed for this."""
    thin = contests.select("seq", "day", "player", "opponent", "result", "is_draw")
    open_ = K.with_prior_history(K.first_per_pair(K.decided(K.within_lookback(thin, lookback, contests))), contests)
    priced = K.both_prices(open_, K.price_table(odds)).filter(F.col("_price").isNotNull() | F.col("_opp_price").isNotNull())
    flagged = contests.join(priced.select("seq", F.lit(True).alias("_bet"), "_price", "_opp_price"), "seq", "left")
    return materialize(flagged.na.fill(False, ["_bet"]))


def candidate_bets(contests: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int | None = None, decay: bool = False, moves: bool = False) -> DataFrame:
    """``bet_records`` of every candidate. History, repeated pairs and prices depend on the contest alone and are joined once per contest before
    the scan; it returns the ratings of those contests, and nothing is joined or shuffled per candidate."""
    carry = ["result", "_bet", "_price", "_opp_price"]
    vectors = rate_vectors(flag_bets(contests, odds, lookback), candidates, decay, moves, carry, emit={"pre": "_bet", "opp_pre": "_bet"})
    return flagged_bets(vectors)


def flagged_bets(vectors: DataFrame) -> DataFrame:
    """Bets per candidate on the rated contests of ``flag_bets``."""
    rows = vectors.filter("_bet").select("seq", "day", "player", "opponent", "result", "_price", "_opp_price", "pre", "opp_pre")
    picked = K.picks(unfold(rows, carry=["result", "_price", "_opp_price"]))
    price = F.when(F.col("pre") > F.col("opp_pre"), F.col("_price")).otherwise(F.col("_opp_price"))
    return K.settle(picked.withColumn("american", price).filter(F.col("american").isNotNull())).drop("_price", "_opp_price")


def train_and_holdout_bets(trained: DataFrame, holdout: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``candidate_bets`` on the training contests and ``oos_bets`` on the holdout, from one scan. Prices and the contests whose ratings the
    holdout is frozen at are joined once for all candidates, and the scan returns only the vectors these need."""
    cards = rename_by_match(K.first_per_pair(K.decided(holdout)), players(trained))
    priced = K.both_prices(cards, K.price_table(odds)).filter(F.col("_price").isNotNull() | F.col("_opp_price").isNotNull())
    known = materialize(priced)
    frozen = materialize(frozen_last(trained, known))
    flagged = flag_frozen(flag_bets(trained, odds, lookback), frozen)
    carry = ["result", "_bet", "_price", "_opp_price", "_own", "_opp"]
    vectors = materialize(rate_vectors(flagged, candidates, carry=carry, emit={"pre": "_bet", "opp_pre": "_bet", **FROZEN}, store=False))
    base = F.array_repeat(F.lit(S.BASE_RATING), len(candidates))
    faced = with_frozen(known, frozen, vectors).withColumns({c: F.coalesce(c, base) for c in ("rating", "opp_rating")})
    return flagged_bets(vectors), K.vector_bets(faced)


def evaluate_roi(contests: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int | None = None, decay: bool = False, moves: bool = False) -> DataFrame:
    """ROI and number of bets of each candidate; no bets give an ROI of zero."""
    bets = candidate_bets(contests, odds, candidates, lookback, decay, moves)
    roi = bets.groupBy(*KEYS).agg((F.try_divide(F.sum("profit"), F.sum("stake")) * 100.0).alias("roi"), F.count(F.lit(1)).alias("bets"))
    every = contests.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("candidate_id"))
    return every.join(roi, KEYS, "left").withColumns({"roi": F.coalesce("roi", F.lit(0.0)), "bets": F.coalesce("bets", F.lit(0))})


def evaluate_everything(contests: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int | None = None, weights: dict | None = None) -> DataFrame:
    """ROI metrics plus calibration, AUC and consistency of every candidate, and the weighted search fitness on top.

    One scan for all candidates; the scored table and the bets are written once and every metric aggregates them by candidate.
    """
    thin = contests.select("seq", "day", "player", "opponent")
    rated = materialize(rate(contests, candidates, carry=["result", "is_draw", "played_at", *FLAGS]))
    bets = materialize(K.bet_records(rated, contests, odds, KEYS, lookback))
    roi = M.roi_extended(bets, KEYS).withColumn("roi", F.try_divide(F.col("profit"), F.col("wagered")) * 100.0).select(*KEYS, "roi", "trend", "sharpe", "bets")
    bouts = bout_counts(thin).select("seq", "bouts", "opp_bouts")
    scored = materialize(K.scored(K.within_lookback(rated, lookback, contests), contests).join(bouts, "seq"))
    spread = C.spread(C.by_bucket(scored, C.dimensions(), KEYS), KEYS)
    parts = [M.expected_calibration_error(scored, KEYS), M.auc(scored, KEYS), C.overall(spread, KEYS), M.probability_metrics(scored, KEYS).drop("n"), roi]
    out = rated.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("candidate_id"))
    for p in parts:
        out = out.join(p, KEYS, "left")
    out = out.withColumn("roi", F.coalesce("roi", F.lit(0.0)))
    return out.withColumn("fitness", FIT.search_fitness("roi", "trend", "sharpe", "ece", "consistency_variance", "auc", weights))


def train_val_side(df: DataFrame, source: DataFrame, lookback: int, validation: float) -> DataFrame:
    """Rows of the look-back window tagged ``train`` (up to the middle, inclusive) or ``val``."""
    train_days = int(lookback * (1 - validation))
    start = source.agg(F.date_sub(F.max("day"), lookback)).scalar()
    inside = df.filter(F.col("day") > start)
    return inside.withColumn("side", F.when(F.col("day") <= F.date_add(start, train_days), "train").otherwise("val"))


def evaluate_train_val(contests: DataFrame, odds: DataFrame, candidates: list[dict], lookback: int = 365, validation: float = 0.5, threshold: float = 2.0) -> DataFrame:
    """ROI on both parts of the look-back window and the fitness that punishes a gap between them."""
    bets = train_val_side(candidate_bets(contests, odds, candidates), contests, lookback, validation)
    # one aggregate for both sides
    parts = {s: F.col("side") == s for s in ("train", "val")}
    g = bets.groupBy(*KEYS).agg(
        *[F.coalesce(F.try_divide(F.sum(F.when(c, F.col("profit"))), F.sum(F.when(c, F.col("stake")))) * 100.0, F.lit(0.0)).alias(f"{s}_roi") for s, c in parts.items()],
        *[F.count_if(c).alias(f"{s}_bets") for s, c in parts.items()],
    )
    every = contests.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("candidate_id"))
    g = every.join(g, "candidate_id", "left").na.fill(0)
    gap = F.col("train_roi") - F.col("val_roi")
    return g.withColumns({"gap": gap, "overfitted": (gap > threshold).cast("int"), "fitness": FIT.overfit_fitness("train_roi", "val_roi", threshold)})


def feature_configs(base: dict | None = None) -> list[dict]:
    """The eight on/off combinations of phased decay, weight moves and a free scale."""
    out = []
    for phased in (0, 1):
        for moves in (0, 1):
            for scale in (0, 1):
                name = "+".join(n for n, on in (("md", phased), ("wa", moves), ("ed", scale)) if on) or "baseline"
                c = {"k": 60.0, **(base or {})}
                if phased:
                    c |= {"multiphase": 1.0, "quick_days": 45.0, "quick_bump": 1.05, "decay_days": 180.0, "phase_rate": 0.002}
                if moves:
                    c |= {"weight_moves": 1.0, "up_penalty": 0.95, "up_bonus": 1.05}
                if scale:
                    c |= {"scale": 300.0}
                out.append({"name": name, "params": c})
    return out


def rank_configs(evaluated: DataFrame, names: list[str]) -> DataFrame:
    """Configurations by ROI, best first, nulls last, with the spread over all of them."""
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("candidate_id") + 1)
    w = W.orderBy(F.col("roi").desc_nulls_last(), "candidate_id")
    alls = W.partitionBy()
    return evaluated.select(
        named.alias("config"), "roi", "bets", F.row_number().over(w).alias("rank"),
        F.max("roi").over(alls).alias("best_roi"), F.min("roi").over(alls).alias("worst_roi"), F.avg("roi").over(alls).alias("mean_roi"),
    )


def generation_stats(evaluated: DataFrame, groups: list[str], score: str = "fitness") -> DataFrame:
    return evaluated.groupBy(*groups).agg(
        F.max_by("candidate_id", F.struct(F.col(score), -F.col("candidate_id"))).alias("best_candidate"),
        F.max(score).alias("best"), F.avg(score).alias("mean"), F.min(score).alias("worst"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("n"),
    )


# --- proposing parameter sets: tens of rows per generation, so this stays on the driver ---


def search_bounds(decay: bool = False, phased: bool = False, moves: bool = False, scale: bool = False) -> dict:
    return {**BOUNDS, **(DECAY_BOUNDS if decay else {}), **(PHASE_BOUNDS if phased else {}), **(MOVE_BOUNDS if moves else {}), **(SCALE_BOUNDS if scale else {})}


def _fit(name: str, value: float, bounds: dict) -> float:
    lo, hi = bounds[name]
    value = min(max(value, lo), hi)
    return float(int(value)) if name in WHOLE else value


def random_candidate(rng: random.Random, bounds: dict) -> dict:
    return {n: _fit(n, rng.uniform(*b), bounds) for n, b in bounds.items()}


def next_generation(population: list[tuple[dict, float]], rng: random.Random, bounds: dict, rate_: float = 0.3, width: float = 0.1) -> list[dict]:
    """Keep the best, fill up with mutated children of tournament winners (three contenders each)."""

    def parent() -> dict:
        return max(rng.sample(population, min(3, len(population))), key=lambda p: p[1])[0]

    def child() -> dict:
        a, b = parent(), parent()
        mixed = {n: _fit(n, (a[n] + b[n]) / 2 if rng.random() < 0.5 else rng.choice((a[n], b[n])), bounds) for n in bounds}
        changed = [n for n in bounds if rng.random() < rate_]
        if not changed and rng.random() < 0.5:
            changed = [rng.choice(list(bounds))]
        for n in changed:
            lo, hi = bounds[n]
            mixed[n] = _fit(n, mixed[n] + rng.gauss(0.0, width * (hi - lo)), bounds)
        return mixed

    best = max(population, key=lambda p: p[1])[0]
    return [best] + [child() for _ in range(len(population) - 1)]


def search(score_generation, bounds: dict, population: int, generations: int, seed: int = 42, fixed: dict | None = None) -> list[dict]:
    """Evolve parameter sets. ``score_generation(candidates)`` evaluates a whole generation as one Spark job and returns a table
    with ``candidate_id`` and ``fitness``; one row per candidate comes back to the driver."""
    rng = random.Random(seed)
    current = [random_candidate(rng, bounds) for _ in range(population)]
    log = []
    for g in range(generations):
        table = score_generation([{**(fixed or {}), **c} for c in current]).select("candidate_id", "fitness").collect()
        scores = {r["candidate_id"]: r["fitness"] for r in table}
        scored = [(c, scores.get(i) if scores.get(i) is not None else float("-inf")) for i, c in enumerate(current)]
        log += [{"generation": g, "candidate_id": i, "fitness": f, **c} for i, (c, f) in enumerate(scored)]
        if g + 1 < generations:
            current = next_generation(scored, rng, bounds)
    return log


STATE = "candidate_id int, fitness double, oos_accuracy double, params map<string,double>, seed long, population int, generation int"


def _stored(spark: SparkSession, folder: str, generation: int) -> list:
    """Rows of a generation that was written to its end, in order; none if it was not."""
    path = f"{folder}/generation={generation}"
    try:
        done = spark.read.text(f"{path}/_done").count() > 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return spark.read.schema(STATE).parquet(f"{path}/rows").orderBy("candidate_id").collect() if done else []


def resumable_search(spark: SparkSession, score_generation, bounds: dict, population: int, generations: int, folder: str, seed: int = 42, fixed: dict | None = None) -> DataFrame:
    """``search`` whose generations are kept in ``folder``: (generation, candidate_id, fitness, oos_accuracy, params, seed).

    A generation is one Spark job and is written before the next is proposed, with a marker after its rows. Proposals depend on the seed, the
    generation's number and the rows before it only, so a driver that starts again on the folder skips finished generations, repeats an
    unfinished one and ends with the table of an undisturbed run. More generations than before continue the search; another seed or
    population is refused. Only one generation's rows (as many as the population) are on the driver.
    """
    for g in range(generations):
        rows = _stored(spark, folder, g)
        if rows and (len(rows) != population or rows[0]["seed"] != seed):
            raise ValueError(f"{folder} holds a search of another seed or population")
        if not rows:
            rng = random.Random(f"{seed}:{g}")
            current = [random_candidate(rng, bounds) for _ in range(population)] if g == 0 else next_generation(before, rng, bounds)
            params = spark.createDataFrame([(i, {n: float(v) for n, v in c.items()}) for i, c in enumerate(current)], "candidate_id int, params map<string,double>")
            scored = score_generation([{**(fixed or {}), **c} for c in current])
            outside = F.col("oos_accuracy") if "oos_accuracy" in scored.columns else F.lit(None).cast("double")
            table = params.join(scored.select("candidate_id", "fitness", outside.alias("oos_accuracy")), "candidate_id", "left")
            table = table.select("candidate_id", "fitness", "oos_accuracy", "params", F.lit(seed).cast("long").alias("seed"), F.lit(population).alias("population"), F.lit(g).alias("generation"))
            path = f"{folder}/generation={g}"
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/rows")
            spark.createDataFrame([(str(g),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_done")
            rows = _stored(spark, folder, g)
        before = [(dict(r["params"]), r["fitness"] if r["fitness"] is not None else float("-inf")) for r in rows]
    paths = [f"{folder}/generation={g}/rows" for g in range(generations)]
    return spark.read.schema(STATE).parquet(*paths)


def search_stats(log: DataFrame) -> DataFrame:
    """Fitness and out-of-sample accuracy of every generation: best, mean, worst and deviation, and both of the best candidate so far."""
    sums = [f(c).alias(f"{n}{tail}") for c, tail in (("fitness", ""), ("oos_accuracy", "_oos")) for n, f in (("best", F.max), ("mean", F.avg), ("worst", F.min), ("sd", F.stddev_pop))]
    top = F.max_by(F.struct("candidate_id", "oos_accuracy"), F.struct("fitness", -F.col("candidate_id")))
    g = log.groupBy("generation").agg(*sums, F.count(F.lit(1)).alias("n"), top.alias("top"))
    # one row per generation
    upto = W.orderBy("generation").rowsBetween(W.unboundedPreceding, 0)
    return g.select("*", F.col("top.candidate_id").alias("best_candidate"), F.col("top.oos_accuracy").alias("best_candidate_oos"), F.max("best").over(upto).alias("best_so_far")).drop("top")
