"""Parameter sweeps: every query evaluates its whole candidate list as one keyed job."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import r6
from ..operators import consistency as C
from ..operators import documents as D
from ..operators import oos as O
from ..operators import splits as X
from ..operators import sweep as Z
from ..operators.prefix import exact_quantiles
from ..session import materialize, shared_dir
from ..sources import sinks
from . import query
from . import sqltext as T
from .betting import DAILY, EXTENDED, PM, _rounded
from ..functions import fitness as FIT
from .metrics import _ALL_DIMS, _BOUTS_SQL
from .lookups import HOLD, HOLD_DAYS, _LATEST_SQL, oos_pred_sql, train_part

GRID = Z.k_grid()
_GRID_SQL = f"""gq AS (SELECT quantile_cont(epoch_us(played_at)::DOUBLE, 0.8) AS q FROM ev),
gr AS (SELECT candidate_id, avg(correct) AS accuracy, avg(correct) FILTER (WHERE epoch_us(played_at) > q) AS later_accuracy, count(*) FILTER (WHERE epoch_us(played_at) > q) AS later_rows FROM pred, gq GROUP BY candidate_id)"""


@query(
    "k_grid_sweep",
    T.sql(
        T.EV, T.scan_sql("ev", GRID), T.pred_sql("ev"), _GRID_SQL,
        select=f"""SELECT gr.candidate_id, c.k AS k, c.use_method AS use_method, {T.r6('accuracy')} AS accuracy, {T.r6('later_accuracy')} AS later_accuracy, later_rows,
  (row_number() OVER (PARTITION BY use_method ORDER BY later_accuracy DESC NULLS LAST, gr.candidate_id) = 1)::INT AS is_best FROM gr JOIN rated_c c USING (candidate_id)""",
    ),
)
def k_grid_sweep(t):
    c = materialize(t.events_contests())
    cut = exact_quantiles(c.select(S.epoch_micros("played_at").alias("x")), "x", [0.8]).scalar()
    g = Z.grid_accuracy(c, GRID, cut, S.epoch_micros("played_at"))
    params = c.sparkSession.createDataFrame([(i, x["k"], x["use_method"]) for i, x in enumerate(GRID)], "candidate_id int, k double, use_method double")
    return _rounded(Z.best_of(g.join(F.broadcast(params), "candidate_id"), "later_accuracy", ["use_method"]))


OOS_GRID = Z.k_grid()


@query(
    "k_oos_sweep",
    T.sql(*HOLD, T.scan_sql("tr", OOS_GRID), _LATEST_SQL, oos_pred_sql("hold", min_bouts=0), select=f"SELECT candidate_id, count(*) AS n, {T.r6('avg(correct)')} AS accuracy FROM oq GROUP BY candidate_id"),
)
def k_oos_sweep(t):
    c = materialize(t.orders_contests())
    train = train_part(c)
    p = O.oos_grid(train, t.holdout(c, HOLD_DAYS), OOS_GRID, match=False)
    return _rounded(O.oos_accuracy(p).select("candidate_id", "n", "accuracy"))


CANDS = [{"k": 32.0}, {"k": 170.0}, {"k": 250.0, "use_method": 0.0}, {"k": 90.0, "w_ko": 1.25, "w_sub": 1.5, "w_udec": 1.1, "w_sdec": 0.8, "w_mdec": 0.95}]
_EVAL_TAIL = (
    T.bets_sql("oc"), DAILY, EXTENDED,
    T.pred_sql("oc", dedup=True),
    f"ex AS (SELECT candidate_id, CASE WHEN count(*) >= 2 THEN regr_slope(cum_roi, x) END AS trend, CASE WHEN count(*) >= 2 AND stddev_samp(roi) > 0 THEN avg(roi) / stddev_samp(roi) * sqrt(52) END AS sharpe, sum(bets)::BIGINT AS bets, sum(profit) / sum(stake) * 100 AS roi FROM dx GROUP BY ALL)",
    f"pm AS (SELECT candidate_id, {PM} FROM pred GROUP BY ALL)",
)


@query(
    "evaluate_candidates",
    T.sql(
        T.OC, T.odds_sql("oc"), T.scan_sql("oc", CANDS), *_EVAL_TAIL,
        select=f"SELECT candidate_id, {T.r6('roi')} AS roi, bets, {T.r6('trend')} AS trend, {T.r6('sharpe')} AS sharpe, accuracy, log_loss, brier, n FROM ex JOIN pm USING (candidate_id)",
    ),
)
def evaluate_candidates(t):
    c = materialize(t.orders_contests())
    e = Z.evaluate(c, t.odds(c), CANDS)
    return _rounded(e.select("candidate_id", "roi", "bets", "trend", "sharpe", "accuracy", "log_loss", "brier", "n"))


_TV_SQL = """tv AS (SELECT candidate_id, profit, CASE WHEN day <= (SELECT max(day) - 730 + 365 FROM oc) THEN 'train' ELSE 'val' END AS side FROM bets WHERE day > (SELECT max(day) - 730 FROM oc)),
te AS (SELECT candidate_id, coalesce(avg(profit) FILTER (WHERE side = 'train') * 100, 0) AS train_roi, coalesce(avg(profit) FILTER (WHERE side = 'val') * 100, 0) AS val_roi, count(*) FILTER (WHERE side = 'train') AS train_bets, count(*) FILTER (WHERE side = 'val') AS val_bets FROM tv GROUP BY ALL),
tf AS (SELECT *, train_roi - val_roi AS gap, CASE WHEN train_roi - val_roi > 2.0 THEN 0.5 * val_roi ELSE 0.7 * val_roi + 0.3 * train_roi END AS fitness FROM te)"""


@query(
    "evaluate_train_val",
    T.sql(
        T.OC, T.odds_sql("oc"), T.scan_sql("oc", CANDS), T.bets_sql("oc"), _TV_SQL,
        select=f"SELECT candidate_id, {T.r6('train_roi')} AS train_roi, {T.r6('val_roi')} AS val_roi, train_bets, val_bets, {T.r6('gap')} AS gap, (gap > 2.0)::INT AS overfitted, {T.r6('fitness')} AS fitness FROM tf",
    ),
)
def evaluate_train_val(t):
    c = materialize(t.orders_contests())
    return _rounded(Z.evaluate_train_val(c, t.odds(c), CANDS, 730, 0.5))


CONFIGS = Z.feature_configs()
_CONFIG_CANDS = [x["params"] for x in CONFIGS]
_NAMES = [x["name"] for x in CONFIGS]


@query(
    "config_ranking",
    T.sql(
        T.EV, T.odds_sql("ev"), T.scan_sql("ev", _CONFIG_CANDS, decay=True, moves=True), T.bets_sql("ev"),
        "cr AS (SELECT candidate_id, avg(profit) * 100 AS roi, count(*) AS bets FROM bets GROUP BY ALL)",
        select=f"SELECT {_NAMES}[candidate_id + 1] AS config, {T.r6('roi')} AS roi, bets, row_number() OVER (ORDER BY roi DESC NULLS LAST, candidate_id)::INT AS rank, {T.r6('max(roi) OVER ()')} AS best_roi, {T.r6('min(roi) OVER ()')} AS worst_roi, {T.r6('avg(roi) OVER ()')} AS mean_roi FROM cr",
    ),
)
def config_ranking(t):
    c = materialize(t.events_contests())
    e = Z.evaluate_roi(c, t.odds(c), _CONFIG_CANDS, decay=True, moves=True)
    return _rounded(Z.rank_configs(e, _NAMES))


GENERATIONS = [{"k": 20.0 + 35.0 * i, "w_ko": 1.0 + (i % 5) / 5.0, "w_sdec": 0.6 + (i % 3) / 6.0} for i in range(12)]


@query(
    "sweep_summary",
    T.sql(
        T.OC, T.odds_sql("oc"), T.scan_sql("oc", GENERATIONS), T.bets_sql("oc"),
        "gs AS (SELECT candidate_id, (candidate_id // 4)::INT AS generation, avg(profit) * 100 AS fitness FROM bets GROUP BY ALL)",
        select=f"SELECT generation, arg_max(candidate_id, (fitness, -candidate_id)) AS best_candidate, {T.r6('max(fitness)')} AS best, {T.r6('avg(fitness)')} AS mean, {T.r6('min(fitness)')} AS worst, {T.r6('stddev_pop(fitness)')} AS sd, count(*) AS n FROM gs GROUP BY generation",
    ),
)
def sweep_summary(t):
    c = materialize(t.orders_contests())
    bets = Z.candidate_bets(c, t.odds(c), GENERATIONS)
    e = bets.groupBy("candidate_id").agg((F.sum("profit") / F.sum("stake") * 100.0).alias("fitness"))
    return _rounded(Z.generation_stats(e.withColumn("generation", F.floor(F.col("candidate_id") / 4).cast("int")), ["generation"]))


def _accuracy_scorer(t):
    """Scores candidates on the training part by accuracy after its 0.8 quantile, and on the holdout out of sample."""
    c = t.orders_contests()
    train = materialize(train_part(c))
    hold = materialize(t.holdout(c, HOLD_DAYS))
    cut = exact_quantiles(train.select(S.epoch_micros("played_at").alias("x")), "x", [0.8]).scalar()
    return lambda cands: Z.evaluate_accuracy(train, cands, cut, S.epoch_micros("played_at"), hold)


_STATS = ("best", "mean", "worst", "sd", "best_oos", "mean_oos", "worst_oos", "sd_oos")
_STAT_SQL = ", ".join(f"{T.r6(f'{f}({c})')} AS {n}" for n, (f, c) in zip(_STATS, ((f, c) for c in ("fitness", "oos") for f in ("max", "avg", "min", "stddev_pop"))))


@query(
    "generation_accuracy",
    T.sql(
        *HOLD, T.scan_sql("tr", GENERATIONS), _LATEST_SQL, oos_pred_sql("hold", min_bouts=0), T.pred_sql("tr"), _GRID_SQL.replace("FROM ev", "FROM tr"),
        "oa AS (SELECT candidate_id, avg(correct) AS oos FROM oq GROUP BY candidate_id)",
        "ga AS (SELECT (candidate_id // 4)::INT AS generation, candidate_id, later_accuracy AS fitness, oos FROM gr JOIN oa USING (candidate_id))",
        f"gs AS (SELECT generation, count(*) AS n, {_STAT_SQL}, arg_max(candidate_id, (fitness, -candidate_id)) AS best_candidate, {T.r6('arg_max(oos, (fitness, -candidate_id))')} AS best_candidate_oos FROM ga GROUP BY generation)",
        select="SELECT *, max(best) OVER (ORDER BY generation) AS best_so_far FROM gs",
    ),
)
def generation_accuracy(t):
    """Statistics by generation of accuracy as the objective, with out-of-sample accuracy beside it."""
    e = _accuracy_scorer(t)(GENERATIONS)
    return _rounded(Z.search_stats(e.withColumn("generation", F.floor(F.col("candidate_id") / 4).cast("int"))))


@query("search_accuracy")
def search_accuracy(t):
    """Three generations of six of a seeded search on accuracy; each is one Spark job whose rows are kept, so that a lost driver goes on."""
    folder = f"{shared_dir(t.spark).rstrip('/')}/boutline-search-{uuid.uuid4().hex}"
    log = Z.resumable_search(t.spark, _accuracy_scorer(t), Z.search_bounds(), population=6, generations=3, folder=folder)
    return log.select("generation", "candidate_id", r6("fitness").alias("fitness"), r6("oos_accuracy").alias("oos_accuracy"), r6(F.col("params")["k"]).alias("k"))


@query("search_generation")
def search_generation(t):
    """Two generations of a seeded search on train/validation fitness; each generation is one Spark job."""
    c = materialize(t.orders_contests())
    odds = t.odds(c)
    log = Z.search(lambda cands: Z.evaluate_train_val(c, odds, cands, 730, 0.5), Z.search_bounds(), population=6, generations=2)
    rows = [(x["generation"], x["candidate_id"], float(x["fitness"]), x["k"]) for x in log]
    table = c.sparkSession.createDataFrame(rows, "generation int, candidate_id int, fitness double, k double")
    return table.select("generation", "candidate_id", r6("fitness").alias("fitness"), r6("k").alias("k"))


_WEIGHTS = {"roi": 0.4, "calibration": 0.2, "consistency": 0.2, "auc": 0.2}
_PER = "PARTITION BY candidate_id"
_FULL_SQL = (
    T.bets_sql("oc"), DAILY, EXTENDED, T.pred_sql("oc"), *_BOUTS_SQL,
    "ex AS (SELECT candidate_id, regr_slope(cum_roi, x) AS trend, avg(roi) / stddev_samp(roi) * sqrt(52) AS sharpe, sum(bets)::BIGINT AS bets, sum(profit) / sum(stake) * 100 AS roi FROM dx GROUP BY ALL)",
    "bi AS (SELECT candidate_id, least(floor(prob * 10), 9) AS bin, count(*) AS n, abs(avg(prob) - avg(result)) AS gap FROM pred GROUP BY ALL)",
    "be AS (SELECT candidate_id, sum(n * gap) / sum(n) AS ece FROM bi GROUP BY ALL)",
    "au AS (SELECT candidate_id, prob, sum(result) AS pos, sum(1 - result) AS neg FROM pred GROUP BY ALL)",
    f"ar AS (SELECT *, coalesce(sum(neg) OVER ({_PER} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM au)",
    "ax AS (SELECT candidate_id, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM ar GROUP BY ALL)",
    "dm AS (" + " UNION ALL ".join(f"SELECT candidate_id, '{d}' AS dimension, {e} AS bucket, avg(((prob > 0.5)::INT = result)::INT) AS accuracy FROM (SELECT * FROM pred JOIN bc USING (seq)) GROUP BY ALL" for d, e in _ALL_DIMS) + ")",
    "cv AS (SELECT candidate_id, avg(v) AS variance FROM (SELECT candidate_id, dimension, CASE WHEN count(*) > 1 THEN var_pop(accuracy) END AS v FROM dm GROUP BY ALL) GROUP BY ALL)",
    f"pm AS (SELECT candidate_id, {PM} FROM pred GROUP BY ALL)",
    "fz AS (SELECT * FROM ex JOIN be USING (candidate_id) JOIN ax USING (candidate_id) JOIN cv USING (candidate_id) JOIN pm USING (candidate_id))",
)
_FITNESS_SQL = "greatest(0.0, least(10.0, (roi + 20.0) / 5.0)) * 0.4 + greatest(0.0, least(10.0, (coalesce(trend, 0) + 1.0) * 5.0)) * 0.1 + greatest(0.0, least(10.0, (coalesce(sharpe, 0) + 2.0) * 2.0)) * 0.1 + 10.0 / (1.0 + ece * 50.0) * 0.2 + 10.0 / (1.0 + variance * 500.0) * 0.2 + greatest(0.0, least(10.0, (auc - 0.5) * 20.0)) * 0.2"


@query(
    "evaluate_everything",
    T.sql(
        T.OC, T.odds_sql("oc"), T.scan_sql("oc", CANDS), *_FULL_SQL,
        select=f"SELECT candidate_id, bets, {T.r6('roi')} AS roi, {T.r6('trend')} AS trend, {T.r6('sharpe')} AS sharpe, {T.r6('ece')} AS ece, {T.r6('auc')} AS auc, {T.r6('variance')} AS consistency_variance, accuracy, {T.r6(_FITNESS_SQL)} AS fitness FROM fz",
    ),
)
def evaluate_everything(t):
    """All metrics of a search run and the weighted fitness, for every candidate at once."""
    c = materialize(t.orders_contests())
    e = Z.evaluate_everything(c, t.odds(c), CANDS, None, _WEIGHTS)
    return _rounded(e.select("candidate_id", "bets", "roi", "trend", "sharpe", "ece", "auc", "consistency_variance", "accuracy", "fitness"))


@query("search_splits")
def search_splits(t):
    """A seeded search whose fitness is the split ROI's mean less its spread; each generation is one job over all splits."""
    c = materialize(t.orders_contests())
    odds = materialize(t.odds(c))
    splits = X.make_splits(c, 12, "expanding", 12)

    def score(cands):
        s = X.split_statistics(X.split_roi(X.split_bets(c, odds, cands, splits), cands, splits))
        return s.select("candidate_id", FIT.split_fitness("mean", "std").alias("fitness"))

    log = Z.search(score, Z.search_bounds(), population=5, generations=2)
    table = c.sparkSession.createDataFrame([(x["generation"], x["candidate_id"], float(x["fitness"]), x["k"]) for x in log], "generation int, candidate_id int, fitness double, k double")
    return table.select("generation", "candidate_id", r6("fitness").alias("fitness"), r6("k").alias("k"))


RUN_CONFIGS = [{"name": n, "params": c} for n, c in zip(("plain", "grid", "no_method", "method"), CANDS)]
_RUN_DRAWDOWN = """cu AS (SELECT candidate_id, day, seq, round(sum(profit) OVER (PARTITION BY candidate_id ORDER BY day, seq), 9) AS v FROM bets),
fa AS (SELECT candidate_id, max(dd) AS max_drawdown FROM (SELECT candidate_id, max(v) OVER (PARTITION BY candidate_id ORDER BY day, seq) - v AS dd FROM cu) GROUP BY ALL)"""
_RUN_SCALARS = {
    "summary.roi_percent": "roi", "summary.accuracy": "accuracy", "summary.sharpe_ratio": "sharpe", "summary.win_rate": "win_rate", "summary.num_bets": "bets", "summary.ece": "ece",
    "summary.brier_score": "brier", "summary.log_loss": "log_loss", "summary.calibration_slope": "slope", "summary.auc_roc": "auc", "summary.consistency_variance": "variance",
    "summary.max_drawdown": "max_drawdown", "best_fitness": "fitness", "best_metrics.train.roi_percent": "train_roi", "best_metrics.train.num_bets": "train_bets",
    "best_metrics.val.roi_percent": "val_roi", "best_metrics.val.num_bets": "val_bets", "best_metrics.oos.accuracy": "oos_accuracy", "best_metrics.oos.n": "oos_n", "best_params.k": "k",
}
_RUN_NAME = "['plain', 'grid', 'no_method', 'method'][candidate_id + 1]"


def _run_rows(path: str, value: str, source: str) -> str:
    return f"SELECT {_RUN_NAME} AS config, {path} AS path, {T.r6(f'({value})::DOUBLE')} AS value FROM {source}"


_RUN_SELECT = " UNION ALL ".join(
    [_run_rows(f"'{p}'", v, "fy") for p, v in _RUN_SCALARS.items()]
    + [
        _run_rows("'calibration_curve.' || (bin * 10)::INT || '-' || ((bin + 1) * 10)::INT || '%.' || f", "CASE f WHEN 'predicted' THEN p WHEN 'actual' THEN a ELSE n END", "rb, (VALUES ('predicted'), ('actual'), ('count')) t(f)"),
        _run_rows("'consistency_breakdown.by_' || dimension || '.' || bucket", "accuracy", "dm"),
        _run_rows("'roi_by_decile.' || (bin * 10) || '-' || ((bin + 1) * 10) || '%'", "roi", "rd"),
        _run_rows("'master.rank'", "row_number() OVER (ORDER BY roi DESC NULLS LAST, candidate_id)", "fy"),
    ]
)


def _run_oracle() -> str:
    return T.sql(
        *HOLD, T.scan_sql("tr", CANDS, name="rated_t"), _LATEST_SQL.replace("rated", "rated_t"), oos_pred_sql("hold", min_bouts=0),
        T.odds_sql("oc"), T.scan_sql("oc", CANDS), *_FULL_SQL, _TV_SQL, _RUN_DRAWDOWN,
        "oa AS (SELECT candidate_id, avg(correct) AS oos_accuracy, count(*) AS oos_n FROM oq GROUP BY candidate_id)",
        "sl AS (SELECT candidate_id, regr_slope(result, prob) AS slope FROM pred GROUP BY ALL)",
        "wr AS (SELECT candidate_id, avg(bet_won) AS win_rate FROM bets GROUP BY ALL)",
        "rb AS (SELECT candidate_id, least(floor(prob * 10), 9) AS bin, count(*) AS n, avg(prob) AS p, avg(result) AS a FROM pred GROUP BY ALL)",
        "rd AS (SELECT candidate_id, greatest(ceil(prob * 10) - 1, 0)::INT AS bin, avg(profit) * 100 AS roi FROM bets GROUP BY ALL)",
        f"fy AS (SELECT fz.*, {_FITNESS_SQL} AS fitness, max_drawdown, slope, win_rate, oos_accuracy, oos_n, train_roi, train_bets, val_roi, val_bets, c.k FROM fz JOIN fa USING (candidate_id) JOIN sl USING (candidate_id) JOIN wr USING (candidate_id) JOIN oa USING (candidate_id) JOIN tf USING (candidate_id) JOIN rated_c c USING (candidate_id))",
        select=_RUN_SELECT,
    )


@query("run_documents", _run_oracle())
def run_documents(t):
    """Documents of four configurations and the master file, written, read back and listed as one row per number in them."""
    c = materialize(t.orders_contests())
    run = {"source": "orders"}
    docs = materialize(D.run_documents(c, t.odds(c), RUN_CONFIGS, run=run, weights=_WEIGHTS, holdout=t.holdout(c, HOLD_DAYS), holdout_days=HOLD_DAYS))
    folder = f"{shared_dir(t.spark).rstrip('/')}/boutline-run-{uuid.uuid4().hex}"
    sinks.write_run(folder, docs, D.master_document(docs, run))
    back, master = sinks.read_run(t.spark, folder)

    def rows(name, schema, pairs):
        entries = F.explode(F.from_json(F.get_json_object("document", f"$.{name}"), f"array<struct<{schema}>>")).alias("e")
        listed = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{name}."), p).alias("path"), v.cast("double").alias("value")) for p, v in pairs])).alias("r")
        return back.select("config", entries).select("config", listed).select("config", "r.*")

    e = lambda x: F.col(f"e.{x}")
    scalars = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object("document", f"$.{p}").cast("double").alias("value")) for p in _RUN_SCALARS])).alias("r")
    out = [back.select("config", scalars).select("config", "r.*")]
    out.append(rows("calibration_curve", "range:string,predicted:double,actual:double,count:long", [(F.concat(e("range"), F.lit(f".{x}")), e(x)) for x in ("predicted", "actual", "count")]))
    out += [rows(f"consistency_breakdown.by_{x}", "bucket:string,accuracy:double", [(e("bucket"), e("accuracy"))]) for x in C.dimensions()]
    out.append(rows("roi_by_decile", "decile:string,roi:double", [(e("decile"), e("roi"))]))
    ranks = F.explode(F.from_json(F.get_json_object("document", "$.configurations"), "array<struct<config_name:string,rank:int>>")).alias("e")
    out.append(master.select(ranks).select(e("config_name").alias("config"), F.lit("master.rank").alias("path"), e("rank").cast("double").alias("value")))
    return _rounded(reduce(lambda a, b: a.unionByName(b), out))
