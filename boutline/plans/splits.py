"""Time splits and cross-validated ROI."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fitness as FIT
from ..functions.scalar import r6
from ..operators import splits as X
from ..session import materialize
from . import query
from . import sqltext as T
from .betting import _rounded


def bounds_sql(src, months, min_train, window):
    train = f"(SELECT min(day) FROM {src})" if window == "expanding" else f"(v - INTERVAL {months} MONTH)::DATE"
    return f"""vb AS (SELECT (min(day) + INTERVAL {min_train} MONTH)::DATE AS v FROM {src} UNION ALL SELECT (v + INTERVAL {months} MONTH)::DATE FROM vb WHERE (v + INTERVAL {months} MONTH)::DATE < (SELECT max(day) FROM {src})),
vw AS (SELECT v AS val_start, (v + INTERVAL {months} MONTH)::DATE AS val_end, {train} AS train_start FROM vb WHERE v < (SELECT max(day) FROM {src})),
vt AS (SELECT w.val_start AS vs, w.val_end AS ve, w.train_start AS ts, e.*, CASE WHEN e.day < w.val_start THEN 'train' ELSE 'val' END AS side FROM vw w JOIN {src} e ON e.day >= w.train_start AND e.day < w.val_end),
vk AS (SELECT vs, count(*) FILTER (WHERE side = 'val') AS nv, count(*) FILTER (WHERE side = 'train') AS nt FROM vt GROUP BY vs HAVING nv > 0 AND nt >= 10),
vi AS (SELECT vs, (row_number() OVER (ORDER BY vs) - 1)::INT AS split_id FROM vk),
tg AS (SELECT split_id, vt.* FROM vt JOIN vi USING (vs))"""


_REPORT = """SELECT split_id, CAST(min(day) FILTER (WHERE side = 'train') AS VARCHAR) AS train_start, CAST(max(day) FILTER (WHERE side = 'train') AS VARCHAR) AS train_end, count(*) FILTER (WHERE side = 'train') AS train_rows,
  CAST(min(day) FILTER (WHERE side = 'val') AS VARCHAR) AS val_start, CAST(max(day) FILTER (WHERE side = 'val') AS VARCHAR) AS val_end, count(*) FILTER (WHERE side = 'val') AS val_rows FROM tg GROUP BY split_id"""


def _report(c, splits):
    d = ("train_start", "train_end", "val_start", "val_end")
    return X.report(c, splits).withColumns({x: F.col(x).cast("string") for x in d})


@query("time_splits", T.sql(T.OC, bounds_sql("oc", 6, 6, "rolling"), select="SELECT split_id, side, seq FROM tg"))
def time_splits(t):
    c = t.orders_contests().select("seq", "day")
    return X.tag(c, X.make_splits(c, 6, "rolling", 6)).select("split_id", "side", "seq")


@query("time_splits_offset", T.sql(T.OC, bounds_sql("oc", 12, 24, "expanding"), select=_REPORT))
def time_splits_offset(t):
    c = t.orders_contests().select("seq", "day")
    return _report(c, X.make_splits_by_offset(c, "1Y", "expanding", 2))


@query("split_info", T.sql(T.OC, bounds_sql("oc", 6, 6, "expanding"), select=_REPORT))
def split_info(t):
    c = t.orders_contests().select("seq", "day")
    return _report(c, X.make_splits(c, 6, "expanding", 6))


@query(
    "train_val_windows",
    T.sql(
        T.OC,
        "mx AS (SELECT max(day) - 400 AS a, max(day) - 400 + 280 AS b FROM oc)",
        select="SELECT CASE WHEN day <= b THEN 'train' ELSE 'val' END AS side, count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM oc, mx WHERE day > a GROUP BY ALL",
    ),
)
def train_val_windows(t):
    from ..operators.sweep import train_val_side

    c = t.orders_contests().select("seq", "day")
    g = train_val_side(c, c, 400, 0.3).groupBy("side")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


SPLIT_CANDS = [{"k": 32.0}, {"k": 150.0, "w_ko": 1.8}, {"k": 90.0, "w_sub": 1.7, "w_sdec": 0.6}]


def _split_tail(latest):
    return f"""{T.prices_sql('odds', 'spx')},
sv AS (SELECT * FROM tg WHERE side = 'val' AND {T.DECIDED} QUALIFY row_number() OVER (PARTITION BY split_id, {T.PAIR} ORDER BY seq) = 1),
{latest},
s2 AS (SELECT *, CASE WHEN r1 > r2 THEN player ELSE opponent END AS bet_on, CASE WHEN r1 > r2 THEN opponent ELSE player END AS bet_against, (CASE WHEN r1 > r2 THEN result = 1 ELSE result = 0 END)::INT AS bet_won FROM s1 WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r1 <> r2),
s3 AS (SELECT k.*, coalesce(p.american, q.american) AS american FROM s2 k LEFT JOIN spx p ON p.player = k.bet_on AND p.opponent = k.bet_against AND p.day = k.day LEFT JOIN spx q ON q.opponent = k.bet_on AND q.player = k.bet_against AND q.day = k.day),
s4 AS (SELECT *, CASE WHEN bet_won = 1 THEN decimal - 1.0 ELSE -1.0 END AS profit FROM (SELECT *, {T.DECIMAL} AS decimal FROM s3) WHERE decimal IS NOT NULL),
sg AS (SELECT c.candidate_id, i.split_id, count(s4.seq) AS bets, count(s4.seq)::DOUBLE AS wagered, coalesce(sum(profit), 0.0) AS profit, coalesce(sum(bet_won), 0)::BIGINT AS wins
  FROM (SELECT DISTINCT candidate_id FROM rated) c CROSS JOIN vi i LEFT JOIN s4 ON s4.candidate_id = c.candidate_id AND s4.split_id = i.split_id GROUP BY ALL),
sr AS (SELECT *, CASE WHEN wagered > 0 THEN profit / wagered * 100 ELSE 0.0 END AS roi FROM sg)"""


_EXPANDING = """hs AS (SELECT candidate_id, who, day, max_by(post, seq * 2 + side) AS post FROM (SELECT candidate_id, day, seq, 0 AS side, player AS who, post FROM rated UNION ALL SELECT candidate_id, day, seq, 1, opponent, opp_post FROM rated) GROUP BY ALL),
sp AS (SELECT c.candidate_id, v.split_id, v.vs, x.who FROM (SELECT DISTINCT candidate_id FROM rated) c CROSS JOIN (SELECT DISTINCT split_id, vs FROM tg) v CROSS JOIN (SELECT DISTINCT who FROM hs) x),
sl AS (SELECT sp.candidate_id, sp.split_id, sp.who, hs.post AS rating FROM sp ASOF JOIN hs ON hs.candidate_id = sp.candidate_id AND hs.who = sp.who AND sp.vs > hs.day),
s1 AS (SELECT v.*, c.candidate_id, a.rating AS r1, b.rating AS r2 FROM sv v CROSS JOIN (SELECT DISTINCT candidate_id FROM rated) c LEFT JOIN sl a ON a.candidate_id = c.candidate_id AND a.split_id = v.split_id AND a.who = v.player LEFT JOIN sl b ON b.candidate_id = c.candidate_id AND b.split_id = v.split_id AND b.who = v.opponent)"""
_ROLLING = """sl AS (SELECT candidate_id, split_id, who, max_by(post, (day, seq, side)) AS rating FROM (SELECT candidate_id, split_id, day, seq, 0 AS side, player AS who, post FROM rated UNION ALL SELECT candidate_id, split_id, day, seq, 1, opponent, opp_post FROM rated) GROUP BY ALL),
s1 AS (SELECT v.*, c.candidate_id, a.rating AS r1, b.rating AS r2 FROM sv v CROSS JOIN (SELECT DISTINCT candidate_id FROM rated) c LEFT JOIN sl a ON a.candidate_id = c.candidate_id AND a.split_id = v.split_id AND a.who = v.player LEFT JOIN sl b ON b.candidate_id = c.candidate_id AND b.split_id = v.split_id AND b.who = v.opponent)"""
_EXPANDING_SQL = (T.OC, T.odds_sql("oc"), bounds_sql("oc", 12, 12, "expanding"), T.scan_sql("oc", SPLIT_CANDS), _split_tail(_EXPANDING))
_ROLLING_SQL = (T.OC, T.odds_sql("oc"), bounds_sql("oc", 12, 12, "rolling"), "tt AS (SELECT * FROM tg WHERE side = 'train')", T.scan_sql("tt", SPLIT_CANDS, key="split_id"), _split_tail(_ROLLING))
_SR = f"SELECT candidate_id, split_id, bets, {T.r6('wagered')} AS wagered, {T.r6('profit')} AS profit, wins, {T.r6('roi')} AS roi FROM sr"


def split_rois(t, window, candidates):
    c = materialize(t.orders_contests())
    splits = X.make_splits(c, 12, window, 12)
    return X.split_roi(X.split_bets(c, t.odds(c), candidates, splits, window), candidates, splits)


@query("split_roi", T.sql(*_EXPANDING_SQL, select=_SR))
def split_roi(t):
    return _rounded(split_rois(t, "expanding", SPLIT_CANDS))


@query("split_roi_rolling", T.sql(*_ROLLING_SQL, select=_SR))
def split_roi_rolling(t):
    return _rounded(split_rois(t, "rolling", SPLIT_CANDS))


@query(
    "split_fitness",
    T.sql(
        *_EXPANDING_SQL,
        "sm AS (SELECT candidate_id, avg(roi) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(roi) ELSE 0 END AS std, count(*) AS splits, sum(bets)::BIGINT AS bets FROM sr GROUP BY candidate_id)",
        "sc AS (SELECT *, CASE WHEN abs(mean) > 0.001 THEN std / abs(mean) WHEN std = 0 THEN 0.0 ELSE 1e6 END AS cv FROM sm)",
        select=f"SELECT candidate_id, splits, bets, {T.r6('mean')} AS mean, {T.r6('std')} AS std, {T.r6('cv')} AS cv, {T.r6('mean - 0.5 * std')} AS fitness, {T.r6('100.0 - 100.0 * least(cv, 100.0)')} AS cv_fitness FROM sc",
    ),
)
def split_fitness(t):
    s = X.split_statistics(split_rois(t, "expanding", SPLIT_CANDS))
    return s.select(
        "candidate_id", "splits", "bets", r6("mean").alias("mean"), r6("std").alias("std"), r6(FIT.coefficient_of_variation("mean", "std")).alias("cv"),
        r6(FIT.split_fitness("mean", "std", "mean_std", 0.5)).alias("fitness"), r6(FIT.split_fitness("mean", "std", "cv")).alias("cv_fitness"),
    )
