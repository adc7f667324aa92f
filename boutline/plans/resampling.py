"""Rolling backtests, robustness, bootstraps, drift reports and event samples."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bets as K
from ..operators import metrics as M
from ..operators import oos as O
from ..operators import ratings as R
from ..operators import resample as B
from ..operators import sweep as Z
from ..operators.prefix import exact_quantiles
from ..session import materialize
from . import query
from . import sqltext as T
from .betting import BETS_EV, BOOKS, CAND, CARRY, RATED_EV, _rounded, rated_events
from .lookups import HOLD, HOLD_DAYS, OOS_BETS_SQL, _LATEST_SQL, train_part
from .metrics import FLAGS

WINDOW_CANDS = [{"k": 32.0}, {"k": 170.0}, {"k": 250.0, "use_method": 0.0}]
_WINDOWS_SQL = """wn AS (SELECT (i + 1)::INT AS window_num, (mx - i * 30)::DATE AS stop, (mx - i * 30 - 90)::DATE AS start FROM (SELECT max(day) AS mx, min(day) AS mn FROM oc), (SELECT i::INT AS i FROM range(10) g(i)) r WHERE (mx - i * 30 - 90)::DATE >= mn + 365),
wz AS (SELECT w.*, (SELECT count(*) FROM oc WHERE day < start) AS train_fights, (SELECT count(*) FROM oc WHERE day >= start AND day < stop) AS test_fights, (SELECT count(*) FROM odds WHERE day >= start AND day < stop) AS test_odds,
  (SELECT max(day) FROM oc WHERE day < start) AS tl, (SELECT max(day) FROM oc WHERE day < stop) AS el FROM wn w),
wr AS (SELECT w.window_num, w.train_fights, w.test_fights, b.candidate_id, coalesce(avg(profit) FILTER (WHERE day < start AND day > tl - 90) * 100, 0) AS train_roi, coalesce(avg(profit) FILTER (WHERE day >= start AND day < stop AND day > el - 90) * 100, 0) AS test_roi
  FROM (SELECT * FROM wz WHERE train_fights >= 100 AND test_fights >= 10 AND test_odds >= 5) w JOIN bets b ON b.day < w.stop GROUP BY ALL)"""


@query(
    "rolling_backtest",
    T.sql(
        T.OC, T.odds_sql("oc"), T.scan_sql("oc", WINDOW_CANDS), T.bets_sql("oc"), _WINDOWS_SQL,
        select=f"SELECT window_num, train_fights, test_fights, candidate_id, {T.r6('train_roi')} AS train_roi, {T.r6('test_roi')} AS test_roi, {T.r6('train_roi - test_roi')} AS roi_drop, (row_number() OVER (PARTITION BY window_num ORDER BY train_roi DESC, candidate_id) = 1)::INT AS is_best FROM wr",
    ),
)
def rolling_backtest(t):
    c = materialize(t.orders_contests())
    odds = t.odds(c)
    bets = K.bet_records(R.rate(c, WINDOW_CANDS, carry=["result", "is_draw"]), c, odds, Z.KEYS)
    g = B.rolling_backtest(bets, c.select("day"), odds.select("day"))
    return _rounded(g.select("window_num", "train_fights", "test_fights", "candidate_id", "train_roi", "test_roi", "roi_drop", "is_best"))


def _random_params(n: int) -> list[dict]:
    rng = random.Random(42)
    return [Z.random_candidate(rng, Z.BOUNDS) for _ in range(n)]


ROBUST = [{"k": 170.0}] + _random_params(10)
_TRAIN_BETS = (T.bets_sql("tr", lookback=90, name="tb"), "tq AS (SELECT candidate_id, avg(profit) * 100 AS train_roi FROM tb GROUP BY ALL)")


@query(
    "param_robustness",
    T.sql(
        *HOLD, T.scan_sql("tr", ROBUST), _LATEST_SQL, T.odds_sql("oc"), OOS_BETS_SQL, *_TRAIN_BETS,
        "rb AS (SELECT candidate_id, (candidate_id = 0)::INT AS searched, coalesce(train_roi, 0) AS train_roi, coalesce(avg(profit) * 100, 0) AS oos_roi, count(*) AS oos_bets FROM tq LEFT JOIN ob USING (candidate_id) GROUP BY ALL)",
        select=f"""SELECT candidate_id, searched, {T.r6('train_roi')} AS train_roi, {T.r6('oos_roi')} AS oos_roi, {T.r6('train_roi - oos_roi')} AS roi_drop, oos_bets,
  ((SELECT max(train_roi - oos_roi) FROM rb WHERE searched = 1) > (SELECT avg(train_roi - oos_roi) + stddev_samp(train_roi - oos_roi) FROM rb WHERE searched = 0))::INT AS overfit_signal FROM rb""",
    ),
)
def param_robustness(t):
    c = materialize(t.orders_contests())
    train = materialize(train_part(c))
    odds = t.odds(c)
    inside, outside = Z.train_and_holdout_bets(train, t.holdout(c, HOLD_DAYS), odds, ROBUST, 90)
    tr = M.roi_summary(inside, Z.KEYS).select("candidate_id", F.col("roi").alias("train_roi"))
    oos = O.oos_roi(outside).select("candidate_id", F.col("roi").alias("oos_roi"), F.col("bets").alias("oos_bets"))
    g = tr.join(oos, "candidate_id", "left").na.fill(0)
    g = g.withColumns({"searched": (F.col("candidate_id") == 0).cast("int"), "roi_drop": F.col("train_roi") - F.col("oos_roi")})
    others = F.when(F.col("searched") == 0, F.col("roi_drop"))
    from pyspark.sql import Window as W

    w = W.partitionBy()
    signal = F.max(F.when(F.col("searched") == 1, F.col("roi_drop"))).over(w) > F.avg(others).over(w) + F.stddev_samp(others).over(w)
    return _rounded(g.withColumn("overfit_signal", signal.cast("int")))


N_DATES, N_ROWS, SAMPLE = 100, 1000, 36


def _h(*parts):
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


_BOOT_DATES = f"""od AS (SELECT day, count(*) AS n FROM odds GROUP BY day), bd AS (SELECT day, sum(profit) AS profit, count(*) AS stake FROM bets GROUP BY day),
dr AS (SELECT i::INT AS replicate, day, n FROM od, range({N_DATES}) r(i) QUALIFY row_number() OVER (PARTITION BY i ORDER BY {_h(42, 'i', 'day')}, day) <= {SAMPLE // 3}),
br AS (SELECT replicate, coalesce(sum(profit) / sum(stake) * 100, 0) AS roi FROM dr LEFT JOIN bd USING (day) GROUP BY replicate HAVING sum(n) >= 10)"""
_DIST = f"count(*) AS n, {T.r6('avg(roi)')} AS mean, {T.r6('stddev_pop(roi)')} AS sd, {T.r6('quantile_cont(roi, 0.05)')} AS p5, {T.r6('quantile_cont(roi, 0.95)')} AS p95, {T.r6('min(roi)')} AS low, {T.r6('max(roi)')} AS high"
GIVEN = -7.5


@query("bootstrap_dates", T.sql(*BETS_EV, _BOOT_DATES, select=f"SELECT {_DIST}, {T.r6(f'CASE WHEN stddev_pop(roi) > 0 THEN ({GIVEN} - avg(roi)) / stddev_pop(roi) ELSE 0 END')} AS z FROM br"))
def bootstrap_dates(t):
    c, rated = rated_events(t)
    odds = t.odds(c)
    return _rounded(B.distribution(B.bootstrap_dates(K.bet_records(rated, c, odds), odds, SAMPLE, N_DATES), GIVEN))


_ELIGIBLE = f"""{T.firsts_sql('ev')}, {T.prices_sql()},
e0 AS (SELECT * FROM rated WHERE {T.DECIDED} QUALIFY row_number() OVER (PARTITION BY {T.PAIR} ORDER BY seq) = 1),
e1 AS (SELECT r.*, CASE WHEN pre > opp_pre THEN player ELSE opponent END AS bet_on, CASE WHEN pre > opp_pre THEN opponent ELSE player END AS bet_against, (CASE WHEN pre > opp_pre THEN result = 1 ELSE result = 0 END)::INT AS bet_won
  FROM e0 r JOIN fd a ON a.who = r.player JOIN fd b ON b.who = r.opponent WHERE r.day > a.d AND r.day > b.d),
e2 AS (SELECT day, seq, CASE WHEN bet_won = 1 THEN decimal - 1 ELSE -1.0 END AS profit FROM (SELECT e1.*, {T.DECIMAL} AS decimal FROM e1 JOIN prices p ON p.player = bet_on AND p.opponent = bet_against AND p.day = e1.day) WHERE decimal IS NOT NULL),
e3 AS (SELECT *, row_number() OVER (ORDER BY day, seq) - 1 AS pos, count(*) OVER () AS n FROM e2),
e4 AS (SELECT i AS replicate, ('0x' || substr({_h(42, 'i', 'j')}, 1, 12))::BIGINT % (SELECT max(n) FROM e3) AS pos, j FROM range({N_ROWS}) r(i), range({4 * SAMPLE + 64}) q(j)),
e5 AS (SELECT replicate, pos FROM (SELECT replicate, pos, min(j) AS o FROM e4 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY o, pos) <= {SAMPLE}),
br AS (SELECT replicate, avg(profit) * 100 AS roi FROM e5 JOIN e3 USING (pos) GROUP BY replicate)"""
SWING = 18.0


def _replicate_rois(t):
    c, rated = rated_events(t)
    eligible = B.eligible_bets(rated, c, t.odds(c)).select("day", "seq", "profit", "stake")
    return B.roi_per_replicate(B.bootstrap_rows(eligible, SAMPLE, N_ROWS))


@query("bootstrap_contests", T.sql(*RATED_EV, T.odds_sql("ev"), _ELIGIBLE, select=f"SELECT {_DIST} FROM br"))
def bootstrap_contests(t):
    return _rounded(B.distribution(_replicate_rois(t)))


@query(
    "swing_pairs",
    T.sql(*RATED_EV, T.odds_sql("ev"), _ELIGIBLE, select=f"SELECT count(*) AS pairs, {T.r6('count(*) / (SELECT count(*) * (count(*) - 1) / 2 FROM br) * 100')} AS share FROM br a JOIN br b ON round(a.roi, 9) - round(b.roi, 9) >= {SWING}"),
)
def swing_pairs(t):
    rois = materialize(_replicate_rois(t).select("replicate", F.round("roi", 9).alias("roi")))
    return _rounded(B.swing_pairs(rois, SWING))


_START = "(SELECT min(day) FROM hold)"


@query(
    "market_shift",
    T.sql(
        *HOLD, T.scan_sql("oc", CAND), T.odds_sql("oc"),
        select=f"""SELECT 'train_odds' AS period, count(*) AS n, {T.r6('avg(american)')} AS mean, {T.r6('stddev_samp(american)')} AS sd, {T.r6('median(american)')} AS median, {T.r6('avg((american < 0)::INT) * 100')} AS negative_share FROM odds WHERE day < {_START} AND american IS NOT NULL
UNION ALL SELECT 'oos_odds', count(*), {T.r6('avg(american)')}, {T.r6('stddev_samp(american)')}, {T.r6('median(american)')}, {T.r6('avg((american < 0)::INT) * 100')} FROM hold WHERE american IS NOT NULL
UNION ALL SELECT 'rating_gap', count(*), {T.r6('avg(abs(pre - opp_pre))')}, {T.r6('stddev_samp(abs(pre - opp_pre))')}, {T.r6('median(abs(pre - opp_pre))')}, NULL FROM rated WHERE day >= {_START} - 90""",
    ),
)
def market_shift(t):
    """Price and rating-gap distributions before and in the holdout."""
    c = materialize(t.orders_contests())
    hold = t.holdout(c, HOLD_DAYS)
    start = hold.agg(F.min("day")).scalar()
    odds = t.odds(c).filter(F.col("day") < start).select(F.col("american").alias("x"))
    gaps = R.rate(c, CAND).filter(F.col("day") >= F.date_sub(start, 90)).select(F.abs(F.col("pre") - F.col("opp_pre")).alias("x"))

    def line(name, df, signs=True):
        df = materialize(df.filter(F.col("x").isNotNull()))
        negative = F.avg((F.col("x") < 0).cast("double")) * 100.0 if signs else F.lit(None).cast("double")
        one = df.agg(F.lit(name).alias("period"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), negative.alias("negative_share"))
        med = exact_quantiles(df, "x", [0.5]).select(F.lit(name).alias("period"), F.col("q0").alias("median"))
        return one.join(med, "period")

    parts = [line("train_odds", odds), line("oos_odds", hold.select(F.col("american").alias("x"))), line("rating_gap", gaps, False)]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "accuracy_vs_roi",
    T.sql(
        *HOLD, T.scan_sql("tr", CAND), _LATEST_SQL, T.odds_sql("oc"), OOS_BETS_SQL, T.bets_sql("tr", lookback=90, name="tb"),
        "look AS (SELECT * FROM rated WHERE day > (SELECT max(day) FROM tr) - 90)", T.pred_sql("tr", dedup=True, rated="look"),
        "ab AS (SELECT (SELECT avg(((prob > 0.5)::INT = result)::INT) FROM pred) AS ta, (SELECT avg(profit) * 100 FROM tb) AS tr_, (SELECT count(*) FROM tb) AS tn, avg(bet_won) AS oa, avg(profit) * 100 AS oroi, count(*) AS onn FROM ob)",
        select=f"""SELECT {T.r6('ta')} AS train_accuracy, {T.r6('tr_')} AS train_roi, tn AS train_bets, {T.r6('oa')} AS oos_accuracy, {T.r6('oroi')} AS oos_roi, onn AS oos_bets, {T.r6('(ta - oa) * 100')} AS accuracy_drop,
  {T.r6('tr_ - oroi')} AS roi_drop, {T.r6('(ta - oa) * 200')} AS expected_drop, (tr_ - oroi > (ta - oa) * 200 + 5)::INT AS unexplained FROM ab""",
    ),
)
def accuracy_vs_roi(t):
    c = materialize(t.orders_contests())
    train = materialize(train_part(c))
    odds = t.odds(c)
    rated = materialize(R.rate(train, CAND, carry=["result", "is_draw"]))
    keys = Z.KEYS
    acc = M.probability_metrics(K.scored(K.within_lookback(rated, 90, train), train, dedup=True, keys=keys), keys).select("candidate_id", F.col("accuracy").alias("train_accuracy"))
    roi = M.roi_summary(K.bet_records(rated, train, odds, keys, 90), keys).select("candidate_id", F.col("roi").alias("train_roi"), F.col("bets").alias("train_bets"))
    oos = O.oos_roi(O.oos_bets(rated, train, t.holdout(c, HOLD_DAYS), odds, CAND)).select(
        "candidate_id", F.col("accuracy").alias("oos_accuracy"), F.col("roi").alias("oos_roi"), F.col("bets").alias("oos_bets")
    )
    g = acc.join(roi, keys).join(oos, keys).drop("candidate_id")
    drop = (F.col("train_accuracy") - F.col("oos_accuracy")) * 100.0
    g = g.withColumns({"accuracy_drop": drop, "roi_drop": F.col("train_roi") - F.col("oos_roi"), "expected_drop": drop * 2.0})
    return _rounded(g.withColumn("unexplained", (F.col("roi_drop") > F.col("expected_drop") + 5).cast("int")))


_LABEL = "CASE " + " ".join(f"WHEN {T.hit(m)} THEN '{S.METHOD_LABELS[m]}'" for m in S.LABEL_ORDER) + " ELSE 'Unknown' END"
_DAYS_SQL = f"""sd AS (SELECT day FROM (SELECT DISTINCT day FROM bets) ORDER BY {_h(7, 'day')}, day LIMIT 5)"""
EVENT_BETS = (*RATED_EV, T.odds_sql("ev"), T.bets_sql("ev", dedup="late", fallback="both"))
_DETAIL_SQL = f"""st AS (SELECT *, {_LABEL} AS method FROM rated QUALIFY row_number() OVER (PARTITION BY {T.PAIR} ORDER BY seq DESC) = 1),
po AS (SELECT DISTINCT ON (least(player, opponent), greatest(player, opponent), day) least(player, opponent) AS pa, greatest(player, opponent) AS pb, day, book_a, book_b FROM odds ORDER BY least(player, opponent), greatest(player, opponent), day, odds_seq),
dt AS (SELECT b.seq, b.day, b.bet_on, b.bet_against, b.bet_won, b.american, b.profit, s.method, s.round, po.book_a, po.book_b, CASE WHEN s.player = b.bet_on THEN s.pre ELSE s.opp_pre END AS on_pre, CASE WHEN s.player = b.bet_on THEN s.post ELSE s.opp_post END AS on_post,
  CASE WHEN s.player = b.bet_on THEN s.opp_pre ELSE s.pre END AS against_pre, CASE WHEN s.player = b.bet_on THEN s.opp_post ELSE s.post END AS against_post
  FROM bets b JOIN sd ON sd.day = b.day LEFT JOIN st s ON least(s.player, s.opponent) = least(b.bet_on, b.bet_against) AND greatest(s.player, s.opponent) = greatest(b.bet_on, b.bet_against) AND s.day = b.day
  LEFT JOIN po ON pa = least(b.bet_on, b.bet_against) AND pb = greatest(b.bet_on, b.bet_against) AND po.day = b.day)"""


def _event_tables(t):
    c, rated = rated_events(t, carry=[*CARRY, *FLAGS, "round"], emit=None)
    rated = materialize(rated)
    odds = t.odds(c)
    bets = materialize(K.bet_records(rated, c, odds, dedup="late", fallback="both"))
    days = materialize(B.sampled_days(bets, 5, 7))
    on_days = lambda df: df.join(F.broadcast(days), "day", "left_semi")
    return c, on_days(rated), on_days(odds), on_days(bets)


@query(
    "event_bet_detail",
    T.sql(
        *EVENT_BETS, _DAYS_SQL, _DETAIL_SQL,
        select=f"SELECT seq, CAST(day AS VARCHAR) AS day, bet_on, bet_against, bet_won, american, {T.r6('profit')} AS profit, method, round, {T.r6('on_pre')} AS on_pre, {T.r6('on_post - on_pre')} AS on_change, {T.r6('against_pre')} AS against_pre, {T.r6('against_post - against_pre')} AS against_change, book_a, book_b FROM dt",
    ),
)
def event_bet_detail(t):
    c, rated, odds, bets = _event_tables(t)
    d = B.bet_detail(bets, rated, odds, BOOKS[1:], S.method_label())
    return _rounded(
        d.select("seq", F.col("day").cast("string").alias("day"), "bet_on", "bet_against", "bet_won", "american", "profit", "method", "round", "on_pre", "on_change", "against_pre", "against_change", "book_a", "book_b")
    )


_UNBET_SQL = f"""{T.firsts_sql('ev', 'ufd')},
u0 AS (SELECT * FROM rated WHERE day IN (SELECT day FROM sd) QUALIFY row_number() OVER (PARTITION BY {T.PAIR} ORDER BY seq) = 1),
u1 AS (SELECT u.* FROM u0 u JOIN ufd a ON a.who = u.player JOIN ufd b ON b.who = u.opponent WHERE {T.DECIDED} AND u.day > a.d AND u.day > b.d
  AND NOT EXISTS (SELECT 1 FROM bets b WHERE b.day = u.day AND least(b.bet_on, b.bet_against) = least(u.player, u.opponent) AND greatest(b.bet_on, b.bet_against) = greatest(u.player, u.opponent))),
uf AS (SELECT DISTINCT ON (least(player, opponent), greatest(player, opponent), day) least(player, opponent) AS pa, greatest(player, opponent) AS pb, day, american FROM odds ORDER BY least(player, opponent), greatest(player, opponent), day, odds_seq),
un AS (SELECT u1.*, f.american FROM u1 LEFT JOIN uf f ON pa = least(u1.player, u1.opponent) AND pb = greatest(u1.player, u1.opponent) AND f.day = u1.day),
ur AS (SELECT *, CASE WHEN american IS NULL OR american = 0 THEN 'no_price' WHEN pre = opp_pre THEN 'equal_ratings' ELSE 'price_not_matched' END AS reason FROM un)"""


@query("unbet_contests", T.sql(*EVENT_BETS, _DAYS_SQL, _UNBET_SQL, select="SELECT seq, CAST(day AS VARCHAR) AS day, player, opponent, american, reason FROM ur"))
def unbet_contests(t):
    c, rated, odds, bets = _event_tables(t)
    return B.unbet(rated, c, bets, odds).select("seq", F.col("day").cast("string").alias("day"), "player", "opponent", "american", "reason")


@query(
    "event_summary",
    T.sql(
        *EVENT_BETS, _DAYS_SQL, _UNBET_SQL,
        select=f"""SELECT CAST(b.day AS VARCHAR) AS day, count(*) AS bets, sum(bet_won)::BIGINT AS won, (count(*) - sum(bet_won))::BIGINT AS lost, {T.r6('sum(stake)::DOUBLE')} AS wagered, {T.r6('sum(payout)')} AS payout, {T.r6('sum(profit)')} AS profit,
  {T.r6('sum(profit) / sum(stake) * 100')} AS roi, (SELECT count(*) FROM ur WHERE ur.day = b.day) AS unbet FROM bets b WHERE day IN (SELECT day FROM sd) GROUP BY b.day""",
    ),
)
def event_summary(t):
    c, rated, odds, bets = _event_tables(t)
    s = B.event_summary(bets, B.unbet(rated, c, bets, odds))
    return _rounded(s.withColumn("day", F.col("day").cast("string")))
