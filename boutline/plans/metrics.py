"""Calibration, consistency, ranking quality and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bets as K
from ..operators import consistency as C
from ..operators import metrics as M
from ..operators import ratings as R
from ..session import materialize
from . import query
from . import sqltext as T
from .betting import BETS_EV, BETS_OC, CARRY, RATED_EV, RATED_OC, _rounded, bets_events, bets_orders, log_loss_sql, rated_events, rated_orders

FLAGS = ["ko", "kod", "subw", "subwd", "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd"]
PRED_EV = (*RATED_EV, T.pred_sql("ev"))
PRED_OC = (*RATED_OC, T.pred_sql("oc"))


def scored_events(t):
    c, rated = rated_events(t)
    return K.scored(rated, c)


def scored_orders(t):
    c, rated = rated_orders(t)
    return K.scored(rated, c)


_BIN = "least(floor(prob * 10), 9)::INT"
_BINS_SQL = f"""bi AS (SELECT candidate_id, {_BIN} AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(result) AS win_rate, avg(((prob > 0.5)::INT = result)::INT) AS accuracy FROM pred GROUP BY ALL)"""


@query("ece_bins", T.sql(*PRED_EV, _BINS_SQL, select=f"SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, {T.r6('mean_prob')} AS mean_prob, {T.r6('win_rate')} AS win_rate, {T.r6('accuracy')} AS accuracy FROM range(10) g(bin) LEFT JOIN bi ON bi.bin = g.bin"))
def ece_bins(t):
    return _rounded(M.with_empty_bins(M.calibration_bins(scored_events(t))))


_ECE = "sum(n * abs(mean_prob - win_rate)) / sum(n)"


@query("ece", T.sql(*PRED_OC, _BINS_SQL, select=f"SELECT {T.r6(_ECE)} AS ece FROM bi"))
def ece(t):
    return _rounded(M.expected_calibration_error(scored_orders(t)))


_SLOPE = f"{T.r6('regr_slope(result, prob)')} AS slope, {T.r6('regr_intercept(result, prob)')} AS intercept, (regr_slope(result, prob) < 0.9)::INT AS overconfident, (regr_slope(result, prob) > 1.1)::INT AS underconfident"


@query("calibration_slope", T.sql(*PRED_EV, select=f"SELECT {_SLOPE} FROM pred"))
def calibration_slope(t):
    return _rounded(M.calibration_line(scored_events(t)))


@query(
    "calibration_all",
    T.sql(*PRED_OC, _BINS_SQL, select=f"SELECT candidate_id, {T.r6('avg(' + log_loss_sql('prob', 'result', '1e-10') + ')')} AS log_loss, {T.r6('avg((prob - result) * (prob - result))')} AS brier, count(*) AS n, (SELECT {T.r6(_ECE)} FROM bi) AS ece, {_SLOPE} FROM pred GROUP BY candidate_id"),
)
def calibration_all(t):
    return _rounded(M.calibration_all(materialize(scored_orders(t)), ["candidate_id"]))


def _scored_dims(t):
    c, rated = rated_orders(t, carry=[*CARRY, *FLAGS])
    bouts = R.bout_counts(c.select("seq", "day", "player", "opponent")).select("seq", "bouts", "opp_bouts")
    return K.scored(rated, c).join(bouts, "seq")


_TIER = "CASE WHEN diff < -200 THEN '<-200' WHEN diff < -100 THEN '[-200, -100)' WHEN diff < 0 THEN '[-100, 0)' WHEN diff < 100 THEN '[0, 100)' WHEN diff < 200 THEN '[100, 200)' ELSE '>=200' END"
_METHOD = "CASE " + " ".join(f"WHEN trim({c}) = '1' THEN '{S.METHOD_LABELS[m]}'" for m in S.LABEL_ORDER for c in S.METHOD_FLAGS[m]) + " ELSE 'Unknown' END"
_GAP = "CASE WHEN abs(bouts - opp_bouts) <= 3 THEN '0-3' WHEN abs(bouts - opp_bouts) <= 10 THEN '4-10' WHEN abs(bouts - opp_bouts) <= 20 THEN '11-20' ELSE '21+' END"
_OPP = "CASE WHEN opp_bouts <= 4 THEN '0-4' WHEN opp_bouts <= 15 THEN '5-15' ELSE '16+' END"
_BOUTS_SQL = (
    T.sides_sql("oc", "bl"),
    "bn AS (SELECT seq, side, row_number() OVER (PARTITION BY who ORDER BY day, seq, side) - 1 AS b FROM bl)",
    "bc AS (SELECT seq, max(CASE WHEN side = 0 THEN b END) AS bouts, max(CASE WHEN side = 1 THEN b END) AS opp_bouts FROM bn GROUP BY seq)",
)


def _dim_sql(pairs):
    return "dm AS (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {e} AS bucket, count(*) AS n, avg(((prob > 0.5)::INT = result)::INT) AS accuracy, avg(prob) AS mean_prob, avg(result) AS win_rate, avg((prob - result) * (prob - result)) AS brier FROM (SELECT * FROM pred JOIN bc USING (seq)) GROUP BY ALL"
        for d, e in pairs
    ) + ")"


_SPREAD_SQL = """sp AS (SELECT dimension, CASE WHEN count(*) > 1 THEN var_pop(accuracy) END AS variance, CASE WHEN count(*) > 1 THEN max(accuracy) - min(accuracy) END AS rng,
  CASE WHEN dimension = 'time_period' AND count(*) >= 3 THEN regr_slope(accuracy, x) END AS slope, count(*) AS buckets FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY bucket) - 1 AS x FROM dm) GROUP BY dimension),
sf AS (SELECT *, CASE WHEN dimension = 'time_period' THEN slope < -0.005 WHEN rng > 0 THEN rng > 0.05 END::INT AS flag FROM sp)"""
_ALL_DIMS = [("elo_tier", _TIER), ("method", _METHOD), ("time_period", "strftime(day, '%Y-%m')"), ("experience_gap", _GAP), ("opp_experience", _OPP)]
_DIM_COLS = "SELECT dimension, bucket, n, " + ", ".join(f"{T.r6(c)} AS {c}" for c in ("accuracy", "mean_prob", "win_rate", "brier")) + ", " + ", ".join(f"(SELECT {T.r6(c)} FROM sf WHERE sf.dimension = dm.dimension) AS {n}" for c, n in (("variance", "variance"), ("rng", "range"), ("slope", "slope"))) + ", (SELECT flag FROM sf WHERE sf.dimension = dm.dimension) AS flag FROM dm"


def _consistency(t, name, period="month"):
    dims = {name: C.dimensions(period)[name]}
    return _rounded(C.with_spread(C.by_bucket(_scored_dims(t), dims)))


for _name, _expr in _ALL_DIMS:
    _key = {"time_period": "consistency_period"}.get(_name, f"consistency_{_name}")
    query(_key, T.sql(*PRED_OC, *_BOUTS_SQL, _dim_sql([(_name, _expr)]), _SPREAD_SQL, select=_DIM_COLS))(lambda t, n=_name: _consistency(t, n))


@query("consistency_quarter", T.sql(*PRED_OC, *_BOUTS_SQL, _dim_sql([("time_period", "year(day) || 'Q' || quarter(day)")]), _SPREAD_SQL, select=_DIM_COLS))
def consistency_quarter(t):
    return _consistency(t, "time_period", "quarter")


@query(
    "consistency_overall",
    T.sql(*PRED_OC, *_BOUTS_SQL, _dim_sql(_ALL_DIMS), _SPREAD_SQL, select=f"SELECT {T.r6('avg(variance)')} AS consistency_variance, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE flag = 1), '') AS flags FROM sf"),
)
def consistency_overall(t):
    return _rounded(C.overall(C.spread(C.by_bucket(_scored_dims(t), C.dimensions()))))


_AUC_SQL = """au AS (SELECT prob, sum(result) AS pos, sum(1 - result) AS neg FROM pred GROUP BY prob),
ar AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM au)"""
_AUC = "sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))"


@query("auc_roc", T.sql(*PRED_OC, _AUC_SQL, select=f"SELECT {T.r6(_AUC)} AS auc FROM ar"))
def auc_roc(t):
    return _rounded(M.auc(scored_orders(t)))


_PR = f"""{T.r6("avg(result) FILTER (WHERE prob > 0.5)")} AS favorite_precision, {T.r6("count(*) FILTER (WHERE prob > 0.5 AND result = 1) / count(*) FILTER (WHERE result = 1)")} AS favorite_recall,
  count(*) FILTER (WHERE prob > 0.5) AS favorites, {T.r6("avg(1 - result) FILTER (WHERE prob <= 0.5)")} AS underdog_precision, count(*) FILTER (WHERE prob <= 0.5) AS underdogs"""


@query("precision_recall", T.sql(*PRED_OC, select=f"SELECT {_PR} FROM pred"))
def precision_recall(t):
    return _rounded(M.precision_recall(scored_orders(t)))


_SEPARATION = f"{T.r6('avg(prob) FILTER (WHERE result = 1)')} AS winners, {T.r6('avg(prob) FILTER (WHERE result = 0)')} AS losers, {T.r6('avg(prob) FILTER (WHERE result = 1) - avg(prob) FILTER (WHERE result = 0)')} AS separation"


@query("confidence_separation", T.sql(*PRED_EV, select=f"SELECT {_SEPARATION} FROM pred"))
def confidence_separation(t):
    return _rounded(M.confidence_separation(scored_events(t)))


_DECILE_SQL = "dc AS (SELECT greatest(ceil(prob * 10) - 1, 0)::INT AS bin, count(*) AS bets, sum(profit) / sum(stake) * 100 AS roi, avg(bet_won) AS win_rate, sum(stake)::DOUBLE AS wagered FROM bets GROUP BY ALL)"


@query(
    "roi_by_decile",
    T.sql(
        *BETS_EV,
        _DECILE_SQL,
        select=f"""SELECT bin, bets, {T.r6('roi')} AS roi, {T.r6('win_rate')} AS win_rate, {T.r6('wagered')} AS wagered, (bin * 10) || '-' || ((bin + 1) * 10) || '%' AS decile,
  (bin = arg_max(bin, (roi, -bin)) OVER ())::INT AS is_best, (bin = arg_min(bin, (roi, bin)) OVER ())::INT AS is_worst FROM dc""",
    ),
)
def roi_by_decile(t):
    return _rounded(M.roi_by_decile(bets_events(t)))


_DRAWDOWN_SQL = """cu AS (SELECT day, seq, round(sum(profit) OVER (ORDER BY day, seq), 9) AS v FROM bets),
pk AS (SELECT *, max(v) OVER (ORDER BY day, seq) AS peak FROM cu),
dr AS (SELECT *, peak - v AS dd, sum((peak - v <= 0)::INT) OVER (ORDER BY day, seq) AS isl FROM pk),
ru AS (SELECT isl, count(*) FILTER (WHERE dd > 0) AS len FROM dr GROUP BY isl),
fm AS (SELECT dd, peak FROM dr ORDER BY dd DESC, day, seq LIMIT 1)"""


@query("max_drawdown", T.sql(*BETS_OC, _DRAWDOWN_SQL, select=f"SELECT {T.r6('dd')} AS max_drawdown, {T.r6('CASE WHEN peak > 0 THEN dd / peak * 100 END')} AS drawdown_pct, (SELECT max(len) FROM ru) AS duration FROM fm"))
def max_drawdown(t):
    return _rounded(M.max_drawdown(materialize(bets_orders(t).select("day", "seq", "profit"))))


def _sharpe_sql(fmt):
    return f"""sd AS (SELECT day, {fmt} AS period, sum(profit) AS profit, sum(stake) AS stake, count(*) AS bets FROM bets GROUP BY ALL),
sh AS (SELECT period, sum(profit) / sum(stake) * 100 AS roi, CASE WHEN count(*) >= 2 AND stddev_samp(profit / stake * 100) > 0 THEN avg(profit / stake * 100) / stddev_samp(profit / stake * 100) END AS sharpe, sum(bets)::BIGINT AS bets FROM sd GROUP BY period)"""


_SH = f"SELECT period, {T.r6('roi')} AS roi, {T.r6('sharpe')} AS sharpe, bets, {T.r6('CASE WHEN count(sharpe) OVER () >= 2 THEN stddev_pop(sharpe) OVER () END')} AS stability FROM sh"


@query("sharpe_by_period", T.sql(*BETS_OC, _sharpe_sql("strftime(day, '%Y-%m')"), select=_SH))
def sharpe_by_period(t):
    return _rounded(M.sharpe_by_period(bets_orders(t), "month"))


@query("sharpe_by_quarter", T.sql(*BETS_OC, _sharpe_sql("year(day) || 'Q' || quarter(day)"), select=_SH))
def sharpe_by_quarter(t):
    return _rounded(M.sharpe_by_period(bets_orders(t), "quarter"))


_IMPLIED_SQL = f"""im AS (SELECT p.*, coalesce(CASE WHEN american > 0 THEN 100.0 / (american + 100.0) WHEN american < 0 THEN abs(american) / (abs(american) + 100.0) END, 0.5) AS implied FROM pred p LEFT JOIN (SELECT player, opponent, day, max_by(american, odds_seq) AS american FROM odds WHERE american IS NOT NULL GROUP BY ALL) q
  ON q.player = p.player AND q.opponent = p.opponent AND q.day = p.day)"""
_VALUE = f"""count(*) FILTER (WHERE prob > implied) AS value_bets, {T.r6('avg(((prob > 0.5)::INT = result)::INT) FILTER (WHERE prob > implied)')} AS accuracy, {T.r6('avg(prob - implied) FILTER (WHERE prob > implied)')} AS mean_edge,
  {T.r6('coalesce(sum(prob - implied) FILTER (WHERE prob > implied), 0)')} AS total_edge, {T.r6('avg((prob > implied)::INT)')} AS share"""


def with_implied(scored, odds):
    """Implied probability of the player's own price; one half where there is none."""
    return scored.join(K.price_table(odds), ["player", "opponent", "day"], "left").withColumn("implied", S.implied_probability("american"))


@query("value_bets", T.sql(*PRED_EV, T.odds_sql("ev"), _IMPLIED_SQL, select=f"SELECT {_VALUE} FROM im"))
def value_bets(t):
    return _rounded(M.value_bets(with_implied(scored_events(t), t.odds(t.events_contests()))))


_KELLY = "((decimal - 1) * prob - (1 - prob)) / (decimal - 1)"


@query(
    "kelly_summary",
    T.sql(*BETS_EV, select=f"SELECT {T.r6(f'avg({_KELLY})')} AS mean_kelly, {T.r6(f'avg(({_KELLY} > 0)::INT) * 100')} AS positive_share, {T.r6(f'max({_KELLY})')} AS max_kelly, {T.r6(f'min({_KELLY})')} AS min_kelly FROM bets WHERE decimal > 1"),
)
def kelly_summary(t):
    return _rounded(M.kelly_summary(bets_events(t)))


def performance(scored, bets, keys):
    """Ranking quality and separation in one row per key, with the best and worst decile."""
    d = M.roi_by_decile(bets, keys)
    edge = d.groupBy(*keys).agg(F.max(F.when(F.col("is_best") == 1, F.col("decile"))).alias("best_decile"), F.max(F.when(F.col("is_worst") == 1, F.col("decile"))).alias("worst_decile"))
    return M.auc(scored, keys).join(M.precision_recall(scored, keys), keys).join(M.confidence_separation(scored, keys), keys).join(edge, keys)


@query(
    "performance_bundle",
    T.sql(
        *PRED_OC, T.odds_sql("oc"), T.bets_sql("oc"), _AUC_SQL, _DECILE_SQL,
        select=f"""SELECT 0 AS candidate_id, (SELECT {T.r6(_AUC)} FROM ar) AS auc, {_PR}, {_SEPARATION},
  (SELECT arg_max(bin * 10 || '-' || (bin + 1) * 10 || '%', (roi, -bin)) FROM dc) AS best_decile, (SELECT arg_min(bin * 10 || '-' || (bin + 1) * 10 || '%', (roi, bin)) FROM dc) AS worst_decile FROM pred""",
    ),
)
def performance_bundle(t):
    c, rated = rated_orders(t)
    rated = materialize(rated)
    return _rounded(performance(K.scored(rated, c), materialize(K.bet_records(rated, c, t.odds(c))), ["candidate_id"]))


@query(
    "comprehensive_summary",
    T.sql(
        *PRED_OC, *_BOUTS_SQL, T.odds_sql("oc"), T.bets_sql("oc"), _BINS_SQL, _dim_sql(_ALL_DIMS), _SPREAD_SQL, _AUC_SQL, _DRAWDOWN_SQL, _IMPLIED_SQL,
        select=f"""SELECT 0 AS candidate_id, count(*) AS predictions, {T.r6('avg(((prob > 0.5)::INT = result)::INT)')} AS accuracy, {T.r6('avg((prob - result) * (prob - result))')} AS brier, (SELECT {T.r6(_ECE)} FROM bi) AS ece,
  {T.r6('regr_slope(result, prob)')} AS slope, (SELECT {T.r6(_AUC)} FROM ar) AS auc, (SELECT {T.r6('avg(variance)')} FROM sf) AS consistency_variance,
  (SELECT coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE flag = 1), '') FROM sf) AS flags, (SELECT {T.r6('sum(profit) / sum(stake) * 100')} FROM bets) AS roi, (SELECT {T.r6('dd')} FROM fm) AS max_drawdown,
  (SELECT count(*) FILTER (WHERE prob > implied) FROM im) AS value_bets, (SELECT {T.r6(f'avg({_KELLY})')} FROM bets) AS mean_kelly FROM pred""",
    ),
)
def comprehensive_summary(t):
    """The whole metric document as one row: every part aggregates one materialised scored table and one bet table."""
    c, rated = rated_orders(t, carry=[*CARRY, *FLAGS])
    rated = materialize(rated)
    odds = t.odds(c)
    bouts = R.bout_counts(c.select("seq", "day", "player", "opponent")).select("seq", "bouts", "opp_bouts")
    scored = materialize(K.scored(rated, c).join(bouts, "seq"))
    bets = materialize(K.bet_records(rated, c, odds))
    keys = ["candidate_id"]
    m = M.probability_metrics(scored, keys).select("candidate_id", F.col("n").alias("predictions"), "accuracy", "brier")
    cons = C.overall(C.spread(C.by_bucket(scored, C.dimensions(), keys), keys), keys)
    parts = [
        M.expected_calibration_error(scored, keys),
        M.calibration_line(scored, keys).select("candidate_id", "slope"),
        M.auc(scored, keys),
        cons,
        M.roi_summary(bets, keys).select("candidate_id", "roi"),
        M.max_drawdown(bets, keys).select("candidate_id", "max_drawdown"),
        M.value_bets(with_implied(scored, odds), keys).select("candidate_id", "value_bets"),
        M.kelly_summary(bets, keys).select("candidate_id", "mean_kelly"),
    ]
    for p in parts:
        m = m.join(p, keys)
    return _rounded(m)
