"""The rating scan: an order-dependent recurrence over contests.

Everything a contest contributes on its own (score, method, decay and weight-move factors) is an ordinary column computed by Spark
beforehand. What is left is the recurrence itself. All queries use ``blocks``; the other forms are exact as well and named by the caller.

* ``blocks``  - consecutive blocks of contests, played by connected players with one vector of all candidates' ratings per player (see
  ``scan``); the players' vectors are written to the shared folder between blocks.
* ``grouped`` - one group per key (candidate, split, league), for short histories only.
* ``waves``   - contests whose two players have no earlier open contest are rated together by joins, wave by wave and without
  Python, while a wave has ``min_wave_rows``; what remains (the chains of a few busy players) is played in blocks per candidate.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalar as S
from ..session import StepTable, materialize, shared_dir
from .prefix import month_slice, running
from .scan import BLOCK_ROWS, BLOCK_VALUES, VectorScan, unfold, whole_bins

MIN_WAVE_ROWS = 20_000  # contests below which a wave of joins costs more than playing them in order

# Columns of a parameter set and what an absent one means.
CANDIDATE_DEFAULTS = {
    "k": 32.0, "w_ko": 1.4, "w_sub": 1.3, "w_udec": 1.0, "w_mdec": 0.9, "w_sdec": 0.7, "scale": 400.0, "use_method": 1.0,
    "decay_mode": "none", "decay_rate": 0.0, "min_days": 180.0,
    "multiphase": 0.0, "quick_days": 30.0, "quick_bump": 1.0, "decay_days": 180.0, "phase_rate": 0.0,
    "weight_moves": 0.0, "up_penalty": 1.0, "up_bonus": 1.0,
}
_CANDIDATE_TYPE = "array<struct<candidate_id:int," + ",".join(
    f"{k}:{'string' if isinstance(v, str) else 'double'}" for k, v in CANDIDATE_DEFAULTS.items()
) + ">>"


def with_candidates(contests: DataFrame, candidates: list[dict]) -> DataFrame:
    """Replicate contests for each parameter set (a driver-side list, tens to hundreds of rows) as a struct column ``c``."""
    rows = [{"candidate_id": i, **CANDIDATE_DEFAULTS, **c} for i, c in enumerate(candidates)]
    table = F.from_json(F.lit(json.dumps(rows)), _CANDIDATE_TYPE)
    return contests.withColumn("c", F.explode(table)).withColumn("candidate_id", F.col("c.candidate_id"))


def sides(contests: DataFrame, *extra: Column) -> DataFrame:
    """Long form, two rows per contest in one scan: side 0 is the player, side 1 the opponent."""
    return contests.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("player").alias("who"), F.col("opponent").alias("versus")),
                F.struct(F.lit(1).alias("side"), F.col("opponent").alias("who"), F.col("player").alias("versus")),
            )
        ).alias("s"),
    ).select("*", "s.side", "s.who", "s.versus", *extra).drop("s")


def both_sides(contests: DataFrame, per_side: DataFrame, columns: list[str], on: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Fold a (seq, side, columns) table back to ``columns`` and ``opp_columns`` with one pre-aggregated join."""
    folded = per_side.groupBy(*on).agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(p + c) for s, p in ((0, ""), (1, "opp_")) for c in columns]
    )
    return contests.join(folded, list(on), "left")


def bout_counts(contests: DataFrame) -> DataFrame:
    """Contests each side has had before this one, in (day, seq) order."""
    long = sides(contests.select("seq", "day", "player", "opponent")).select("seq", "day", "side", "who")
    counted = running(long, ["who"], month_slice("day"), ["day", "seq", "side"], {"bouts": ("count", F.lit(1))}, inclusive=False)
    return both_sides(contests, counted.withColumn("bouts", F.col("bouts").cast("long")), ["bouts"])


def side_weight() -> Column:
    own = F.when(F.col("side") == 0, F.col("weight")).otherwise(F.col("opp_weight"))
    return F.coalesce(own, F.col("contest_weight"))


def previous_weight(contests: DataFrame) -> DataFrame:
    """Own weight of each side and the weight of its last weighed contest on a strictly earlier day.

    Rows are ordered by day only within a (player, day) group summary, so contests of the same day never see each other.
    """
    long = sides(contests.select("seq", "day", "player", "opponent", "weight", "opp_weight", "contest_weight")).withColumn("own_weight", side_weight())
    # last weighed contest of each player and day
    daily = long.filter(F.col("own_weight").isNotNull()).groupBy("who", "day").agg(F.max_by("own_weight", F.struct("seq", "side")).alias("w"))
    latest = F.struct(F.col("day").alias("d"), F.col("w").alias("w"))
    days = long.select("who", "day").distinct().join(daily, ["who", "day"], "left")
    seen = running(days, ["who"], month_slice("day"), ["day"], {"last": ("max", F.when(F.col("w").isNotNull(), latest))}, inclusive=False)
    return long.join(seen.select("who", "day", F.col("last.w").alias("prev_weight")), ["who", "day"], "left").select(
        "seq", "side", "who", "day", "own_weight", "prev_weight"
    )


def weight_moves(contests: DataFrame) -> DataFrame:
    """Contests with ``moved_up``/``moved_down`` and the opponent's pair, against the last earlier weight."""
    moves = previous_weight(contests).select(
        "seq",
        "side",
        F.coalesce(F.col("own_weight") > F.col("prev_weight"), F.lit(False)).cast("int").alias("moved_up"),
        F.coalesce(F.col("own_weight") < F.col("prev_weight"), F.lit(False)).cast("int").alias("moved_down"),
        "prev_weight",
    )
    return both_sides(contests, moves, ["moved_up", "moved_down", "prev_weight"])


def idle_days(contests: DataFrame) -> DataFrame:
    """Days since each side's previous contest in (day, seq) order; null on a debut, zero for a second contest on one day."""
    long = sides(contests.select("seq", "day", "player", "opponent")).select("seq", "day", "side", "who")
    seen = running(long, ["who"], month_slice("day"), ["day", "seq", "side"], {"last_day": ("max", F.col("day"))}, inclusive=False)
    gaps = seen.select("seq", "side", F.datediff("day", "last_day").alias("idle"))
    return both_sides(contests, gaps, ["idle"])


def _base_rows(contests: DataFrame, decay: bool, moves: bool) -> DataFrame:
    """Contests the scan plays, with idle days and weight moves. Those with no result that are not draws are left out, but count before that."""
    base = contests
    if decay:
        base = idle_days(base)
    if moves:
        base = weight_moves(base)
    return _played(base)


def _played(contests: DataFrame) -> DataFrame:
    return contests.filter(F.col("result").isNotNull() | F.col("is_draw"))


def _score() -> Column:
    return F.when(F.col("is_draw"), S.DRAW_K_FACTOR).otherwise(F.col("result"))


def _factors(c, decay: bool, moves: bool) -> dict[str, Column]:
    """Idle factors and bonuses of both sides under a parameter set whose fields ``c(name)`` gives."""
    one = F.lit(1.0)

    def idle_factor(p: str) -> Column:
        if not decay:
            return one
        phased = S.multiphase_factor(p + "idle", c("quick_days"), c("quick_bump"), c("decay_days"), c("phase_rate"))
        plain = F.when(c("decay_rate") > 0, S.decay_factor(c("decay_mode"), p + "idle", c("decay_rate"), c("min_days"))).otherwise(1.0)
        return F.when(c("multiphase") == 1.0, phased).otherwise(plain)

    def moved(p: str) -> Column:
        return (c("weight_moves") == 1.0) & (F.col(p + "moved_up") == 1) if moves else F.lit(False)

    def penalty(p: str) -> Column:
        return F.when(moved(p), c("up_penalty")).otherwise(1.0) if moves else one

    def bonus(p: str, won: float) -> Column:
        return F.when(moved(p) & (_score() == won), c("up_bonus")).otherwise(1.0) if moves else one

    return {"_fa": idle_factor("") * penalty(""), "_fb": idle_factor("opp_") * penalty("opp_"), "_ba": bonus("", 1.0), "_bb": bonus("opp_", 0.0)}


def scan_input(contests: DataFrame, candidates: list[dict], decay: bool = False, moves: bool = False, carry: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Thin scan input keyed by candidate."""
    rows = with_candidates(_base_rows(contests, decay, moves).withColumn("method", S.method_code()), candidates)
    multiplier = F.when(F.col("c.use_method") == 1.0, S.multiplier_of_code("method", {m: F.col(f"c.w_{m}") for m in S.MULTIPLIER_ORDER})).otherwise(1.0)
    keff = F.col("c.k") * multiplier * F.when(F.col("is_draw"), S.DRAW_K_FACTOR).otherwise(1.0)
    return rows.select(
        *keys, "candidate_id", "seq", "day", "player", "opponent", *carry, _score().alias("_s"), keff.alias("_k"), F.col("c.scale").alias("_scale"),
        *[v.alias(n) for n, v in _factors(lambda n: F.col(f"c.{n}"), decay, moves).items()],
    )


def vector_scan(
    contests: DataFrame, candidates: list[dict], decay: bool = False, moves: bool = False, carry: list[str] = (), keys: list[str] = (), emit: dict | None = None
) -> VectorScan:
    """Scan input with one row per contest: candidates are a K table by method, a scale each and, with decay or moves, arrays of factors."""
    full = [{**CANDIDATE_DEFAULTS, **c} for c in candidates]
    # rows of the K table: the methods in the multiplier's order, none, and then all of these for draws
    k = np.array([[c["k"] * (1.0 if m is None or c["use_method"] != 1.0 else c[f"w_{m}"]) for c in full] for m in (*S.MULTIPLIER_ORDER, None)], dtype=float)
    k = np.concatenate([k, k * S.DRAW_K_FACTOR])
    methods = len(S.MULTIPLIER_ORDER)
    method = S.first_match([(S.method_hit(m), F.lit(i)) for i, m in enumerate(S.MULTIPLIER_ORDER)], methods) + F.when(F.col("is_draw"), methods + 1).otherwise(0)
    base, factors = _base_rows(contests, decay, moves), []
    if decay or moves:
        table = F.from_json(F.lit(json.dumps([{"candidate_id": i, **c} for i, c in enumerate(full)])), _CANDIDATE_TYPE)
        each = F.transform(table, lambda c: F.struct(*[v.alias(n) for n, v in _factors(lambda field: c[field], decay, moves).items()]))
        base = base.withColumn("_f", each)
        factors = [F.col(f"_f.{n}").alias(n) for n in ("_fa", "_fb", "_ba", "_bb")]
    rows = base.select(*keys, "seq", "day", "player", "opponent", *carry, _score().alias("_s"), method.cast("int").alias("_m"), *factors)
    return VectorScan(rows, list(keys), k, np.array([float(c["scale"]) for c in full]), bool(factors), emit)


_OUT = ("pre", "opp_pre", "post", "opp_post", "adj_pre", "adj_opp_pre")
_WORK = ("_s", "_k", "_scale", "_fa", "_fb", "_ba", "_bb")


def _recurrence(base: float = S.BASE_RATING, out_names: tuple = _OUT, work: tuple = _WORK):
    """The recurrence over one bounded, ordered group. Built as a closure so that workers need no copy of this package."""

    def recur(pdf: pd.DataFrame, ratings: dict) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "seq"], kind="stable", ignore_index=True)
        out = np.empty((6, len(pdf)))
        cols = [pdf[c].tolist() for c in ("player", "opponent", *work)]
        for i, (a, b, s, k, scale, fa, fb, ba, bb) in enumerate(zip(*cols)):
            ra, rb = ratings.get(a, base), ratings.get(b, base)
            xa, xb = ra * fa, rb * fb
            na = (ra + k * (s - 1.0 / (1.0 + 10.0 ** ((xb - xa) / scale)))) * ba
            nb = (rb + k * ((1.0 - s) - 1.0 / (1.0 + 10.0 ** ((xa - xb) / scale)))) * bb
            ratings[a], ratings[b] = na, nb
            out[:, i] = (ra, rb, na, nb, xa, xb)
        pdf = pdf.drop(columns=list(work))
        for name, values in zip(out_names, out):
            pdf[name] = values
        return pdf

    return recur


def _rated_schema(prepared: DataFrame) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema if f.name not in _WORK]
    return ", ".join(kept + [f"{c} double" for c in _OUT])


def _group_keys(prepared: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, "candidate_id"]


def scan_grouped(prepared: DataFrame, keys: list[str]) -> DataFrame:
    recur = _recurrence()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return recur(pdf, {})

    return prepared.groupBy(*keys).applyInPandas(run, _rated_schema(prepared))


def block_bounds(prepared: DataFrame, keys: list[str], limit: int) -> list[tuple]:
    """Upper ends (day, seq) of consecutive blocks that hold at most about ``limit`` contests per key.

    The driver sees one row per calendar day, plus cut points inside days that alone exceed the limit.
    """
    per_day = prepared.groupBy(*keys, "day").count().groupBy("day").agg(F.max("count").alias("n"), F.sum("count").alias("total")).collect()
    per_day.sort(key=lambda r: r["day"])
    heavy = {r["day"]: -(-2 * r["n"] // limit) for r in per_day if r["n"] > limit}
    cuts = {}
    for day, parts in heavy.items():
        qs = [i / parts for i in range(1, parts)]
        cuts[day] = prepared.filter(F.col("day") == day).agg(F.percentile_approx("seq", qs, 100_000)).first()[0]
    bounds, load, last = [], 0, None
    for r in per_day:
        if load and load + r["n"] > limit:
            bounds.append((last, None))
            load = 0
        if r["day"] in cuts:
            bounds += [(r["day"], q) for q in sorted(set(cuts[r["day"]]))]
            bounds.append((r["day"], None))
        else:
            load += r["n"]
        last = r["day"]
    if load:
        bounds.append((last, None))
    return bounds


def _block_of(bounds: list[tuple]) -> Column:
    far = 2**62
    table = F.from_json(
        F.lit(json.dumps([{"d": str(d), "q": far if q is None else int(q), "b": i} for i, (d, q) in enumerate(bounds)])), "array<struct<d:date,q:bigint,b:int>>"
    )
    here = F.struct(F.col("day").alias("d"), F.col("seq").alias("q"))
    inside = F.filter(table, lambda t: F.struct(t["d"].alias("d"), t["q"].alias("q")) >= here)
    return F.element_at(inside, 1)["b"]


def _write_blocks(prepared: DataFrame, bounds: list[tuple]) -> DataFrame:
    path = f"{shared_dir(prepared.sparkSession).rstrip('/')}/boutline-blocks-{uuid.uuid4().hex}"
    tagged = prepared.withColumn("_block", _block_of(bounds))
    tagged.write.partitionBy("_block").parquet(path)
    return prepared.sparkSession.read.schema(tagged.schema).parquet(path)


def _next_state(state: DataFrame | None, fresh: DataFrame, keys: list[str]) -> DataFrame:
    if state is None:
        return fresh
    kept = state.join(fresh.select(*keys, "who"), [*keys, "who"], "left_anti")
    return kept.unionByName(fresh)


def _play_blocks(rows: DataFrame, keys: list[str], limit: int, state: DataFrame | None, rated: StepTable) -> StructType:
    """Play ``rows`` in order, block by block, starting from ``state`` (keys, who, rating)."""
    bounds = block_bounds(rows, keys, limit)
    blocks, n = _write_blocks(rows, bounds), len(bounds)
    schema = _rated_schema(rows)
    for b in range(n):
        part = blocks.filter(F.col("_block") == b).drop("_block")
        players = part.select(*keys, F.explode(F.array("player", "opponent")).alias("who")).distinct()
        if state is None:
            known = players.withColumn("rating", F.lit(None).cast("double"))
        else:
            known = players.join(state, [*keys, "who"], "left")
        known = known.toDF(*known.columns)
        recur = _recurrence()

        def run(contests: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
            start = start[start["rating"].notna()]
            return recur(contests, dict(zip(start["who"], start["rating"])))

        done = rated.add(part.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(run, schema))
        if b + 1 < n:
            long = sides(done.select(*keys, "day", "seq", "player", "opponent", "post", "opp_post"))
            post = F.when(F.col("side") == 0, F.col("post")).otherwise(F.col("opp_post"))
            fresh = long.groupBy(*keys, "who").agg(F.max_by(post, F.struct("day", "seq", "side")).alias("rating"))
            state = materialize(_next_state(state, fresh, keys))
    return done.schema


def rate_vectors(
    contests: DataFrame,
    candidates: list[dict],
    decay: bool = False,
    moves: bool = False,
    carry: list[str] = (),
    keys: list[str] = (),
    block_rows: int = BLOCK_ROWS,
    emit: dict | None = None,
    store: bool = True,
) -> DataFrame:
    """One row per contest: ``pre``, ``opp_pre``, ``post`` and ``opp_post`` (with decay or moves also ``adj_pre``, ``adj_opp_pre``) are arrays, one
    number per candidate in order. What does not depend on the candidate is best done on these rows, before ``unfold``, and what depends on the
    contests alone before the scan: ``emit`` names the outputs wanted and the (carried) flags of the contests they are wanted for.

    Played by connected players, over the whole history where their groups are small enough and else in blocks; see ``scan``. Days are counted on
    the contests alone, before anything is computed for them. A long history's result is written, as several branches may read it, unless ``store``
    is false.
    """
    keys = list(keys)
    scan = vector_scan(contests, candidates, decay, moves, list(carry), keys, emit)
    limit = max(1, min(block_rows, BLOCK_VALUES // max(1, len(candidates))))
    thin = _played(contests)
    if thin.count() <= limit:
        return scan.play(scan.rows, thin=thin)
    bins = None if keys else whole_bins(thin, limit)
    if bins is not None:
        played = scan.play(scan.rows, bins=bins)
        return materialize(played) if store else played
    bounds = block_bounds(thin, keys, limit)
    return scan.whole(_write_blocks(scan.rows, bounds), len(bounds))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with how many open contests each side has before this one."""
    long = sides(rows.select(*keys, "seq", "day", "player", "opponent")).select(*keys, "seq", "day", "side", "who")
    counted = running(long, [*keys, "who"], month_slice("day"), ["day", "seq", "side"], {"nth": ("count", F.lit(1))}, inclusive=False)
    nth = counted.groupBy(*keys, "seq").agg(
        F.max(F.when(F.col("side") == 0, F.col("nth"))).alias("_na"), F.max(F.when(F.col("side") == 1, F.col("nth"))).alias("_nb")
    )
    return rows.join(nth, [*keys, "seq"])


def _play_wave(open_rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Contests whose two players have no earlier open contest, with their ratings after."""
    a = current.select(*keys, F.col("who").alias("player"), F.col("rating").alias("pre"), F.col("done").alias("_na"))
    o = current.select(*keys, F.col("who").alias("opponent"), F.col("rating").alias("opp_pre"), F.col("done").alias("_nb"))
    ready = open_rows.join(a, [*keys, "player", "_na"]).join(o, [*keys, "opponent", "_nb"])
    ready = ready.withColumns({"adj_pre": F.col("pre") * F.col("_fa"), "adj_opp_pre": F.col("opp_pre") * F.col("_fb")})
    gain = F.col("_s") - S.expected_score("adj_pre", "adj_opp_pre", F.col("_scale"))
    opp_gain = 1.0 - F.col("_s") - S.expected_score("adj_opp_pre", "adj_pre", F.col("_scale"))
    return ready.withColumns(
        {"post": (F.col("pre") + F.col("_k") * gain) * F.col("_ba"), "opp_post": (F.col("opp_pre") + F.col("_k") * opp_gain) * F.col("_bb")}
    )


def scan_waves(prepared: DataFrame, keys: list[str], limit: int = BLOCK_ROWS, min_wave_rows: int = MIN_WAVE_ROWS) -> DataFrame:
    """Join-only waves while they are wide, bounded blocks for what is left.

    A wave costs a few joins whatever its size, so it pays only while it holds many contests. The first waves of a wide history
    take most of it; the long chains of a few busy players remain, and those are played in order from the ratings reached.
    """
    rated = StepTable(prepared.sparkSession)
    columns = [*[c for c in prepared.columns if c not in _WORK], *_OUT]
    open_rows = materialize(_numbered(prepared, keys))
    who = open_rows.select(*keys, F.explode(F.array("player", "opponent")).alias("who")).distinct()
    current = materialize(who.withColumns({"rating": F.lit(S.BASE_RATING), "done": F.lit(0).cast("long")}))
    left = open_rows.count()
    while left:
        wave = materialize(_play_wave(open_rows, current, keys))
        size = wave.count()
        done = rated.add(wave.select(*columns))
        moved = sides(wave.select(*keys, "player", "opponent", "post", "opp_post", "_na", "_nb")).select(
            *keys, "who",
            F.when(F.col("side") == 0, F.col("post")).otherwise(F.col("opp_post")).alias("rating"),
            (F.when(F.col("side") == 0, F.col("_na")).otherwise(F.col("_nb")) + 1).alias("done"),
        )
        current = materialize(_next_state(current, moved, keys))
        open_rows = materialize(open_rows.join(wave.select(*keys, "seq"), [*keys, "seq"], "left_anti"))
        left -= size
        if left and size < min_wave_rows:
            _play_blocks(open_rows.drop("_na", "_nb").select(*prepared.columns), keys, limit, current.select(*keys, "who", "rating"), rated)
            break
    return rated.whole(done.schema)


def rate(
    contests: DataFrame,
    candidates: list[dict],
    decay: bool = False,
    moves: bool = False,
    carry: list[str] = (),
    keys: list[str] = (),
    strategy: str = "blocks",
    block_rows: int = BLOCK_ROWS,
    min_wave_rows: int = MIN_WAVE_ROWS,
    emit: dict | None = None,
) -> DataFrame:
    """Ratings before and after every contest, for every parameter set. ``emit`` as in ``rate_vectors``; the other strategies return all.

    ``carry`` names contest columns to take along; anything else is joined back by ``seq``. ``keys`` are extra scan keys
    already present in ``contests`` (a split or a league), each starting from the base rating.
    """
    if strategy == "blocks":
        return unfold(rate_vectors(contests, candidates, decay, moves, carry, keys, block_rows, emit), list(keys), list(carry))
    if strategy not in ("grouped", "waves"):
        raise ValueError(f"unknown strategy {strategy!r}; use blocks, grouped or waves")
    prepared = scan_input(contests, candidates, decay, moves, list(carry), list(keys))
    by = _group_keys(prepared, list(keys))
    return scan_grouped(prepared, by) if strategy == "grouped" else scan_waves(prepared, by, block_rows, min_wave_rows)
