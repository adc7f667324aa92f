"""Diagnostic bet records and slice reports."""

from __future__ import annotations

from ..functions import scalar as S
from ..operators import diagnostics as D
from ..operators import ratings as R
from ..session import materialize
from . import query
from . import sqltext as T
from .betting import BEFORE, CAND, CARRY, RATED_OC, _rounded
from .metrics import _BOUTS_SQL

LOOKBACK = 1460


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + (f" ELSE '{default}' END" if default else " END")


_EXP = lambda n: _case([(f"coalesce({n}, 0) <= 5", "Unknown"), (f"{n} <= 15", "Novice"), (f"{n} <= 50", "Experienced")], "Veteran")
_LAY = lambda d: _case([(f"{d} IS NULL", "Unknown"), (f"{d} <= 90", "Recent"), (f"{d} <= 180", "Medium"), (f"{d} <= 274", "Long")], "Very Long")
_QUAL = _case([("ar >= 0 AND ar < 1500", "Lower-tier"), ("ar >= 1700", "Elite")], "Mid-tier")
_MARGINS = ("Huge favorite (>300)", "Large favorite (200-300)", "Small favorite (100-200)", "Close (0-100)", "Close underdog (0-100)", "Large underdog (100-200)")
_MARG = _case([(f"o_r - ar > {e}", n) for e, n in zip((300, 200, 100, 0, -100, -200), _MARGINS)], "Very large underdog (200+)")
_METH = "CASE " + " ".join(f"WHEN {T.hit(m)} THEN '{S.METHOD_LABELS[m]}'" for m in S.LABEL_ORDER) + " ELSE 'Other' END"
def _records_sql(lookback=None):
    recent = f" WHERE day > (SELECT max(day) FROM oc) - {lookback}" if lookback else ""
    return (
        *RATED_OC, T.odds_sql("oc"), *_BOUTS_SQL,
        f"rl AS (SELECT * FROM rated{recent})", f"ol AS (SELECT * FROM oc{recent})",
        T.bets_sql("ol", fallback="mirror", rated="rl"),
        T.sides_sql("oc", "yl"), "yd AS (SELECT DISTINCT who, day FROM yl)", "yp AS (SELECT who, day, lag(day) OVER (PARTITION BY who ORDER BY day) AS p FROM yd)",
        f"""rc0 AS (SELECT b.*, bc.bouts, bc.opp_bouts, date_diff('day', x.p, b.day)::INT AS lay, date_diff('day', y.p, b.day)::INT AS olay FROM bets b JOIN bc USING (seq) JOIN yp x ON x.who = b.player AND x.day = b.day JOIN yp y ON y.who = b.opponent AND y.day = b.day),
rc1 AS (SELECT *, CASE WHEN bet_on = player THEN pre ELSE opp_pre END AS o_r, CASE WHEN bet_on = player THEN opp_pre ELSE pre END AS ar, CASE WHEN bet_on = player THEN bouts ELSE opp_bouts END AS ob, CASE WHEN bet_on = player THEN opp_bouts ELSE bouts END AS ab,
  CASE WHEN bet_on = player THEN lay ELSE olay END AS ol_, CASE WHEN bet_on = player THEN olay ELSE lay END AS al_ FROM rc0),
rc AS (SELECT *, strftime(day, '%Y-%m') AS month, {_METH} AS method, {_EXP('ob')} AS on_experience, {_EXP('ab')} AS against_experience, {_LAY('ol_')} AS on_layoff_group, {_LAY('al_')} AS against_layoff_group, {_QUAL} AS quality, {_MARG} AS margin FROM rc1)""",
    )


RECORDS = _records_sql()


def records(t, lookback=None):
    c = materialize(t.orders_contests())
    rated = R.rate(c.withColumn("method", S.method_label("Other")), CAND, carry=[*CARRY, "method"], emit=BEFORE)
    return D.records(rated, c, t.odds(c), lookback)


@query(
    "diagnostic_records",
    T.sql(
        *_records_sql(LOOKBACK),
        select=f"SELECT seq, month, bet_on, bet_won, {T.r6('o_r')} AS on_rating, {T.r6('ar')} AS against_rating, ob AS on_bouts, ab AS against_bouts, ol_ AS on_layoff, al_ AS against_layoff, {T.r6('prob')} AS prob, american, {T.r6('profit')} AS profit, method, on_experience, against_experience, on_layoff_group, against_layoff_group, quality, margin FROM rc",
    ),
)
def diagnostic_records(t):
    return _rounded(
        records(t, LOOKBACK).select(
            "seq", "month", "bet_on", "bet_won", "on_rating", "against_rating", "on_bouts", "against_bouts", "on_layoff", "against_layoff", "prob", "american", "profit", "method",
            "on_experience", "against_experience", "on_layoff_group", "against_layoff_group", "quality", "margin",
        )
    )


_SM = "count(*) AS n, avg(bet_won) AS accuracy, sum(profit) / sum(stake) * 100 AS roi, sum(profit) AS profit, sum(stake)::DOUBLE AS wagered"


def _flag_sql(a):
    plain = [("accuracy < 0.5", "low_accuracy"), ("roi < 0", "negative_roi")]
    if a in ("Experience", "Layoff"):
        return _case(plain, None)
    if a in ("Method", "Opponent Quality"):
        return _case([("accuracy >= 0.65", "strong"), *plain], None)
    if a == "Elo Margin":
        return _case([("lower(subgroup) LIKE '%underdog%' AND roi < -10", "underdog_loss"), *plain, ("accuracy >= 0.7", "strong")], None)
    return "NULL::VARCHAR"


def slices_sql(analyses):
    parts = []
    for a in analyses:
        column, names = D.ANALYSES[a]
        listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
        parts.append(
            f"SELECT '{a}' AS analysis, subgroup, position, n, accuracy, roi, profit, wagered, {_flag_sql(a)} AS flag FROM (SELECT f.subgroup, f.position, coalesce(n, 0) AS n, accuracy, roi, profit, wagered FROM (VALUES {listed}) f(position, subgroup) LEFT JOIN (SELECT {column} AS subgroup, {_SM} FROM rc GROUP BY 1) g ON g.subgroup = f.subgroup)"
        )
    return "sl AS (" + " UNION ALL ".join(parts) + ")"


_SL_COLS = "SELECT analysis, subgroup, n, " + ", ".join(f"{T.r6(c)} AS {c}" for c in ("accuracy", "roi", "profit", "wagered")) + ", flag FROM sl"


def _slice_query(t, analyses):
    return _rounded(D.slices(records(t), analyses).drop("position"))


for _key, _names in {
    "slice_experience": ["Experience", "Opponent Experience"],
    "slice_layoff": ["Layoff"],
    "slice_method": ["Method"],
    "slice_quality": ["Opponent Quality"],
    "slice_margin": ["Elo Margin"],
    "slice_metrics": list(D.ANALYSES),
}.items():
    query(_key, T.sql(*RECORDS, slices_sql(_names), select=_SL_COLS))(lambda t, n=_names: _slice_query(t, n))


_MONTH_SQL = f"""mo0 AS (SELECT month, {_SM} FROM rc GROUP BY month),
mo1 AS (SELECT *, row_number() OVER (ORDER BY month) AS i, row_number() OVER (ORDER BY month DESC) AS j, count(*) OVER () AS k FROM mo0),
mo AS (SELECT month, n, accuracy, roi, profit, wagered, (SELECT CASE WHEN max(k) >= 4 THEN regr_slope(accuracy, i - 1) END FROM mo1) AS slope,
  CASE WHEN k >= 3 AND j <= 3 AND (SELECT avg(accuracy) FILTER (WHERE CASE WHEN k >= 6 THEN i <= 3 ELSE i <= k // 2 END) - avg(accuracy) FILTER (WHERE j <= 3) FROM mo1) > 0.05 THEN 'falling' END AS flag FROM mo1)"""


@query("slice_month_drift", T.sql(*RECORDS, _MONTH_SQL, select="SELECT month, n, " + ", ".join(f"{T.r6(c)} AS {c}" for c in ("accuracy", "roi", "profit", "wagered", "slope")) + ", flag FROM mo"))
def slice_month_drift(t):
    return _rounded(D.monthly(records(t)))


_CAL_SQL = """ca0 AS (SELECT least(floor(prob * 10), 9)::INT AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(bet_won) AS win_rate FROM rc GROUP BY 1),
ca AS (SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, mean_prob, win_rate, (g.bin * 10) || '-' || ((g.bin + 1) * 10) || '%' AS decile, abs(mean_prob - win_rate) AS gap,
  CASE WHEN abs(mean_prob - win_rate) <= 0.05 THEN 'CALIBRATED' WHEN win_rate > mean_prob THEN 'UNDERCONFIDENT' WHEN win_rate IS NOT NULL THEN 'OVERCONFIDENT' END AS status,
  (SELECT sum(n * abs(mean_prob - win_rate)) / sum(n) FROM ca0) AS ece FROM range(10) g(bin) LEFT JOIN ca0 ON ca0.bin = g.bin)"""


@query("slice_calibration", T.sql(*RECORDS, _CAL_SQL, select="SELECT bin, n, decile, status, " + ", ".join(f"{T.r6(c)} AS {c}" for c in ("mean_prob", "win_rate", "gap", "ece")) + " FROM ca"))
def slice_calibration(t):
    return _rounded(D.calibration(records(t)))


_SUMMARY_SQL = """su0 AS (SELECT day, sum(profit) AS profit FROM rc GROUP BY day),
su AS (SELECT count(*) AS n, avg(bet_won) AS accuracy, sum(profit) / sum(stake) * 100 AS roi, (SELECT CASE WHEN count(*) > 1 AND stddev_samp(profit) > 0 THEN avg(profit) / stddev_samp(profit) * sqrt(52) END FROM su0) AS sharpe FROM rc)"""


@query("diagnostic_summary", T.sql(*RECORDS, _SUMMARY_SQL, select=f"SELECT n, {T.r6('accuracy')} AS accuracy, {T.r6('roi')} AS roi, {T.r6('sharpe')} AS sharpe FROM su"))
def diagnostic_summary(t):
    return _rounded(D.summary(records(t)))


_SPOTS_SQL = "wk AS (SELECT CASE WHEN flag <> 'strong' THEN 'weak' ELSE 'strong' END AS kind, analysis AS category, subgroup, n, accuracy, roi, flag AS issue FROM sl WHERE flag IS NOT NULL)"


@query("weak_spots", T.sql(*RECORDS, slices_sql(D.ANALYSES), _SPOTS_SQL, select=f"SELECT kind, category, subgroup, n, {T.r6('accuracy')} AS accuracy, {T.r6('roi')} AS roi, issue FROM wk"))
def weak_spots(t):
    return _rounded(D.spots(D.slices(records(t))))


_FIX_SQL = """CASE WHEN category = 'Method' AND issue = 'low_accuracy' THEN 'lower the weight of this method' WHEN category = 'Elo Margin' AND issue = 'underdog_loss' THEN 'raise the scale of expected scores'
  WHEN category = 'Elo Margin' AND issue = 'negative_roi' THEN 'ask for a larger rating gap' WHEN category = 'Layoff' AND issue = 'low_accuracy' THEN 'try a stronger decay'
  WHEN category IN ('Experience', 'Opponent Experience') AND issue = 'low_accuracy' THEN 'ask for more earlier contests' ELSE 'review this slice' END"""


@query(
    "optimization_targets",
    T.sql(
        *RECORDS, slices_sql(D.ANALYSES), _SPOTS_SQL, _SUMMARY_SQL,
        select=f"SELECT category || ': ' || wk.subgroup AS subgroup, {T.r6('wk.accuracy')} AS accuracy, {T.r6('greatest(0.55, su.accuracy)')} AS target_accuracy, {T.r6('coalesce(wk.roi, 0)')} AS roi, wk.n AS n, {T.r6('(greatest(0.55, su.accuracy) - wk.accuracy) * 200 * wk.n / su.n')} AS impact, {_FIX_SQL} AS fix FROM wk, su WHERE kind = 'weak' AND wk.n > 0",
    ),
)
def optimization_targets(t):
    r = materialize(records(t).select("day", "bet_won", "profit", "stake", *[c for c, _ in D.ANALYSES.values()]))
    return _rounded(D.targets(D.spots(D.slices(r)), D.summary(r)))


def _a(a, s=None):
    return f"analysis = '{a}'" + (f" AND subgroup = '{s}'" if s else "")


_INSIGHT_SQL = f"""iw AS (SELECT max(accuracy) FILTER (WHERE {_a('Experience')}) - min(accuracy) FILTER (WHERE {_a('Experience')}) AS exp,
  arg_max(subgroup, (accuracy, -position)) FILTER (WHERE {_a('Experience')} AND accuracy IS NOT NULL) || ' / ' || arg_min(subgroup, (accuracy, position)) FILTER (WHERE {_a('Experience')} AND accuracy IS NOT NULL) AS exp_d,
  avg(accuracy) FILTER (WHERE {_a('Layoff')} AND subgroup <> 'Very Long') - max(accuracy) FILTER (WHERE {_a('Layoff', 'Very Long')}) AS lay,
  max(accuracy) FILTER (WHERE {_a('Method')}) - min(accuracy) FILTER (WHERE {_a('Method')}) AS met,
  arg_max(subgroup, (accuracy, -position)) FILTER (WHERE {_a('Method')} AND accuracy IS NOT NULL) || ' / ' || arg_min(subgroup, (accuracy, position)) FILTER (WHERE {_a('Method')} AND accuracy IS NOT NULL) AS met_d,
  max(accuracy) FILTER (WHERE {_a('Method', 'Split Decision')}) AS split, max(accuracy) FILTER (WHERE {_a('Opponent Quality', 'Elite')}) - max(accuracy) FILTER (WHERE {_a('Opponent Quality', 'Lower-tier')}) AS elite,
  min(roi) FILTER (WHERE {_a('Elo Margin')} AND lower(subgroup) LIKE '%underdog%') AS under FROM sl),
ic AS (SELECT max(ece) AS ece, coalesce(string_agg(decile, ', ' ORDER BY bin) FILTER (WHERE status = 'OVERCONFIDENT' AND n >= 5), '') AS ov, coalesce(string_agg(decile, ', ' ORDER BY bin) FILTER (WHERE status = 'UNDERCONFIDENT' AND n >= 5), '') AS un FROM ca),
im AS (SELECT max(slope) AS slope FROM mo),
ir AS (SELECT 'experience_spread' AS rule, exp AS value, exp > 0.05 AS fired, exp_d AS detail FROM iw UNION ALL SELECT 'long_layoff_drop', lay, lay > 0.05, '' FROM iw UNION ALL SELECT 'method_spread', met, met > 0.10, met_d FROM iw
  UNION ALL SELECT 'split_decisions_hard', split, split < 0.5, '' FROM iw UNION ALL SELECT 'elite_edge', elite, elite > 0.05, '' FROM iw UNION ALL SELECT 'underdog_loss', under, under < -10, '' FROM iw
  UNION ALL SELECT 'drifting_down', slope, slope < -0.005, '' FROM im UNION ALL SELECT 'improving', slope, slope > 0.005, '' FROM im
  UNION ALL SELECT 'ece_grade', ece, ece IS NOT NULL, CASE WHEN ece < 0.03 THEN 'excellent' WHEN ece < 0.06 THEN 'good' WHEN ece < 0.10 THEN 'moderate' ELSE 'poor' END FROM ic
  UNION ALL SELECT 'overconfident_bins', ece, ov <> '', ov FROM ic UNION ALL SELECT 'underconfident_bins', ece, un <> '', un FROM ic)"""


@query("slice_insights", T.sql(*RECORDS, slices_sql(D.ANALYSES), _MONTH_SQL, _CAL_SQL, _INSIGHT_SQL, select=f"SELECT rule, {T.r6('value')} AS value, coalesce(fired, false)::INT AS fired, detail FROM ir"))
def slice_insights(t):
    r = materialize(records(t).select("month", "prob", "bet_won", "profit", "stake", *[c for c, _ in D.ANALYSES.values()]))
    return _rounded(D.insights(D.slices(r), D.monthly(r), D.calibration(r)))
