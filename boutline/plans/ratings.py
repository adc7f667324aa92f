"""Rating scans, histories and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import history as H
from ..operators import ratings as R
from ..session import materialize
from . import query
from . import sqltext as T

BASIC = [{"k": 32.0, "use_method": 0.0}, {"k": 40.0, "use_method": 0.0, "scale": 250.0}]
METHOD = [{"k": 32.0}]
DECAY = [
    {"k": 32.0, "decay_mode": "linear", "decay_rate": 0.0005, "min_days": 180.0},
    {"k": 32.0, "decay_mode": "exponential", "decay_rate": 0.001, "min_days": 90.0},
]
PHASED = [{"k": 60.0, "multiphase": 1.0, "quick_days": 60.0, "quick_bump": 1.05, "decay_days": 200.0, "phase_rate": 0.002}]
MOVES = [{"k": 60.0, "weight_moves": 1.0, "up_penalty": 0.95, "up_bonus": 1.01}]

_RATED_SQL = f"SELECT candidate_id, seq, {T.r6('pre')} AS pre, {T.r6('opp_pre')} AS opp_pre, {T.r6('post')} AS post, {T.r6('opp_post')} AS opp_post"
_ADJ_SQL = f"{_RATED_SQL}, {T.r6('adj_pre')} AS adj_pre, {T.r6('adj_opp_pre')} AS adj_opp_pre FROM rated"


def _show(rated, adjusted=False):
    cols = ["pre", "opp_pre", "post", "opp_post"] + (["adj_pre", "adj_opp_pre"] if adjusted else [])
    return rated.select("candidate_id", "seq", *[r6(c).alias(c) for c in cols])


@query("rating_scan_basic", T.sql(T.EV, T.scan_sql("ev", BASIC), select=_RATED_SQL + " FROM rated"))
def rating_scan_basic(t):
    return _show(R.rate(t.events_contests(), BASIC))


@query("rating_scan_mov", T.sql(T.EV, T.scan_sql("ev", METHOD), select=_RATED_SQL + " FROM rated"))
def rating_scan_mov(t):
    return _show(R.rate(t.events_contests(), METHOD))


@query("rating_scan_decay", T.sql(T.OC, T.scan_sql("oc", DECAY, decay=True), select=_ADJ_SQL))
def rating_scan_decay(t):
    return _show(R.rate(materialize(t.orders_contests()), DECAY, decay=True), True)


@query("rating_scan_multiphase", T.sql(T.OC, T.scan_sql("oc", PHASED, decay=True), select=_ADJ_SQL))
def rating_scan_multiphase(t):
    return _show(R.rate(materialize(t.orders_contests()), PHASED, decay=True), True)


@query("rating_scan_weight", T.sql(T.EV, T.scan_sql("ev", MOVES, moves=True), select=_ADJ_SQL))
def rating_scan_weight(t):
    return _show(R.rate(materialize(t.events_contests()), MOVES, moves=True), True)


@query(
    "weight_change",
    T.sql(T.EV, T.moves_sql("ev"), select="SELECT seq, moved_up, opp_moved_up, moved_down, opp_moved_down, prev_weight, opp_prev_weight FROM moves"),
)
def weight_change(t):
    m = R.weight_moves(t.events_contests())
    return m.select("seq", "moved_up", "opp_moved_up", "moved_down", "opp_moved_down", "prev_weight", "opp_prev_weight")


@query(
    "bout_counts",
    T.sql(
        T.OC,
        T.sides_sql("oc", "l"),
        "n AS (SELECT seq, side, row_number() OVER (PARTITION BY who ORDER BY day, seq, side) - 1 AS b FROM l)",
        select="SELECT seq, max(CASE WHEN side = 0 THEN b END)::BIGINT AS bouts, max(CASE WHEN side = 1 THEN b END)::BIGINT AS opp_bouts FROM n GROUP BY seq",
    ),
)
def bout_counts(t):
    return R.bout_counts(t.orders_contests()).select("seq", "bouts", "opp_bouts")


@query("last_contest_date", T.sql(T.OC, T.sides_sql("oc", "l"), select="SELECT who AS player, CAST(max(day) AS VARCHAR) AS last_day FROM l GROUP BY who"))
def last_contest_date(t):
    return H.player_totals(t.orders_contests()).select("player", F.col("last_day").cast("string").alias("last_day"))


@query("training_bouts", T.sql(T.OC, T.sides_sql("oc", "l"), select="SELECT who AS player, count(*) AS bouts FROM l GROUP BY who"))
def training_bouts(t):
    return H.player_totals(t.orders_contests()).select("player", "bouts")


@query("player_set", T.sql(T.EV, T.sides_sql("ev", "l"), select="SELECT DISTINCT who AS player FROM l"))
def player_set(t):
    return H.players(t.events_contests())


_HIST_SQL = "h AS (SELECT seq, day, 0 AS side, player, pre, post FROM rated UNION ALL SELECT seq, day, 1, opponent, opp_pre, opp_post FROM rated)"


def _history(t):
    return H.history(R.rate(t.events_contests(), METHOD))


@query("rating_history", T.sql(T.EV, T.scan_sql("ev", METHOD), _HIST_SQL, select=f"SELECT seq, side, CAST(day AS VARCHAR) AS day, player, {T.r6('pre')} AS pre, {T.r6('post')} AS post FROM h"))
def rating_history(t):
    return _history(t).select("seq", "side", F.col("day").cast("string").alias("day"), "player", r6("pre").alias("pre"), r6("post").alias("post"))


@query("latest_ratings", T.sql(T.EV, T.scan_sql("ev", METHOD), _HIST_SQL, select=f"SELECT player, {T.r6('max_by(post, seq * 2 + side)')} AS rating FROM h GROUP BY player"))
def latest_ratings(t):
    return H.latest_ratings(_history(t)).select("player", r6("rating").alias("rating"))


@query(
    "current_ratings",
    T.sql(T.EV, T.scan_sql("ev", METHOD), _HIST_SQL, select=f"SELECT player, CAST(day AS VARCHAR) AS day, {T.r6('rating')} AS rating FROM (SELECT player, max(day) AS day, max_by(post, seq * 2 + side) AS rating FROM h GROUP BY player) ORDER BY rating DESC, player LIMIT 100"),
)
def current_ratings(t):
    return H.top_current(_history(t), 100).select("player", F.col("day").cast("string").alias("day"), r6("rating").alias("rating"))


@query("top_peak_ratings", T.sql(T.EV, T.scan_sql("ev", METHOD), _HIST_SQL, select=f"SELECT player, {T.r6('peak')} AS peak FROM (SELECT player, max(post) AS peak FROM h GROUP BY player) ORDER BY peak DESC, player LIMIT 10"))
def top_peak_ratings(t):
    return H.top_peaks(_history(t), 10).select("player", r6("peak").alias("peak"))


@query(
    "player_history",
    T.sql(T.EV, T.scan_sql("ev", METHOD), _HIST_SQL, select=f"SELECT CAST(day AS VARCHAR) AS day, seq, player, {T.r6('pre')} AS pre, {T.r6('post')} AS post FROM h WHERE player = 'José P6' ORDER BY h.day DESC, seq DESC LIMIT 50"),
)
def player_history(t):
    return H.player_rows(_history(t), "José P6", 50).select(F.col("day").cast("string").alias("day"), "seq", "player", r6("pre").alias("pre"), r6("post").alias("post"))


@query("scan_quality", T.sql(T.EV, select="SELECT count(*) AS contests, count(*) FILTER (WHERE seq % 11 = 0 AND NOT is_draw) AS dropped, count(*) FILTER (WHERE is_draw) AS draws FROM ev"))
def scan_quality(t):
    """How many contests the scan leaves out because they have neither a result nor a draw."""
    c = t.events_contests().withColumn("result", F.when((F.col("seq") % 11 != 0) | F.col("is_draw"), F.col("result")))
    return c.agg(
        F.count(F.lit(1)).alias("contests"), F.count_if(F.col("result").isNull() & ~F.col("is_draw")).alias("dropped"), F.count_if("is_draw").alias("draws")
    )
