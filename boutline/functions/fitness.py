"""Fitness expressions over metric columns, and the weight maps they take."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, col, sigmoid

# Keys a weight map may hold and the three sets of default weights.
WEIGHT_KEYS = ("roi", "accuracy", "calibration", "consistency", "auc", "trend", "sharpe", "log_loss", "brier_score", "ece")
MULTI_WEIGHTS = {"roi": 0.4, "accuracy": 0.15, "calibration": 0.15, "consistency": 0.15, "auc": 0.15}
SEARCH_WEIGHTS = {"roi": 0.4, "trend": 0.1, "sharpe": 0.1, "calibration": 0.15, "consistency": 0.15, "auc": 0.1}
COMPOSITE_WEIGHTS = {"roi": 0.4, "accuracy": 0.2, "calibration": 0.15, "consistency": 0.15, "auc": 0.1}


def check_weights(text: str | None) -> dict[str, float]:
    """Validate a JSON weight map given as an argument and scale it to a sum of one."""
    if text is None:
        return dict(MULTI_WEIGHTS)
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"fitness weights are not valid JSON: {e}") from e
    if not isinstance(given, dict):
        raise ValueError("fitness weights must be a JSON object")
    unknown = sorted(set(given) - set(WEIGHT_KEYS))
    if unknown:
        raise ValueError(f"unknown fitness weights {unknown}; allowed: {sorted(WEIGHT_KEYS)}")
    for key, value in given.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
            raise ValueError(f"fitness weight {key} must be a number of at least 0")
    total = sum(given.values())
    if total <= 0:
        raise ValueError("at least one fitness weight must be positive")
    return {k: v / total for k, v in given.items()}


def weights_column(text) -> Column:
    """Column form: JSON text to a normalised map; null if it is not a map of known keys with a positive sum."""
    m = F.from_json(col(text), "map<string,double>")
    values = F.map_values(m)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(-1e300)))
    known = F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in WEIGHT_KEYS]))) == 0
    valid = m.isNotNull() & known & (total > 0) & ~F.exists(values, lambda v: F.coalesce(v < 0, F.lit(True)))
    default = F.create_map(*[F.lit(x) for k, v in MULTI_WEIGHTS.items() for x in (k, v)])
    return F.when(col(text).isNull(), default).when(valid, F.transform_values(m, lambda _, v: v / total))


def _or(value: Column, score: Column, default: float) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(score)


def normalized(roi, accuracy, log_loss, brier, ece, slope, auc, variance, drawdown, trend, sharpe) -> dict[str, Column]:
    """Every metric on a 0-1 scale where more is better."""
    roi, accuracy, log_loss, brier, ece, slope, auc, variance, drawdown, trend, sharpe = map(
        col, (roi, accuracy, log_loss, brier, ece, slope, auc, variance, drawdown, trend, sharpe)
    )
    unit = lambda c: clamp(c, 0.0, 1.0)
    ece_score = _or(ece, unit(1.0 - ece * 5.0), 0.5)
    return {
        "roi": sigmoid(F.coalesce(roi, F.lit(0.0)) / 10.0),
        "accuracy": F.coalesce(accuracy, F.lit(0.5)),
        "log_loss": _or(log_loss, 1.0 / (1.0 + log_loss), 0.5),
        "brier_score": _or(brier, 1.0 - brier, 0.5),
        "ece": ece_score,
        "calibration": ece_score,
        "calibration_slope": _or(slope, unit(1.0 - F.abs(slope - 1.0)), 0.5),
        "auc": _or(auc, unit((auc - 0.5) * 2.0), 0.5),
        "consistency": _or(variance, 1.0 / (1.0 + variance * 100.0), 0.5),
        "max_drawdown": _or(drawdown, 1.0 / (1.0 + drawdown / 10.0), 0.5),
        "trend": _or(trend, sigmoid(trend * 5.0), 0.5),
        "sharpe": _or(sharpe, sigmoid(sharpe), 0.5),
    }


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    terms = [scores[k] * w for k, w in weights.items() if k in scores]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def search_fitness(roi, trend, sharpe, ece, variance, auc, weights: dict[str, float] | None = None) -> Column:
    """Ten-point scores of a search run. Weights are divided by the sum of the given ones only; without any, plain ROI."""
    roi, trend, sharpe, ece, variance, auc = map(col, (roi, trend, sharpe, ece, variance, auc))
    roi = F.coalesce(roi, F.lit(0.0))  # without bets
    if not weights:
        return roi
    total = sum(weights.values())
    w = {k: weights.get(k, d) / total for k, d in SEARCH_WEIGHTS.items()}
    ten = lambda c: clamp(c, 0.0, 10.0)
    zero = lambda c, d=0.0: F.when(c.isNull() | (c == 0), F.lit(d)).otherwise(c)
    return (
        ten((roi + 20.0) / 5.0) * w["roi"]
        + ten((zero(trend) + 1.0) * 5.0) * w["trend"]
        + ten((zero(sharpe) + 2.0) * 2.0) * w["sharpe"]
        + _or(ece, 10.0 / (1.0 + ece * 50.0), 5.0) * w["calibration"]
        + _or(variance, 10.0 / (1.0 + variance * 500.0), 5.0) * w["consistency"]
        + ten((zero(auc, 0.5) - 0.5) * 20.0) * w["auc"]
    )


def composite_fitness(roi, accuracy, ece, variance, auc, weights: dict[str, float] | None = None) -> Column:
    roi, accuracy, ece, variance, auc = map(col, (roi, accuracy, ece, variance, auc))
    merged = {**COMPOSITE_WEIGHTS, **(weights or {})}
    total = sum(merged.values())
    w = {k: v / total for k, v in merged.items()}
    # a metric of exactly zero counts as missing here
    given = lambda c, d: F.when(c.isNull() | (c == 0), F.lit(d)).otherwise(c)
    return (
        given(roi, 0.0) * w["roi"]
        + given(accuracy, 0.0) * 100.0 * w["accuracy"]
        + F.greatest(F.lit(0.0), (0.1 - given(ece, 0.1)) * 1000.0) * w["calibration"]
        + F.greatest(F.lit(0.0), (0.01 - given(variance, 0.01)) * 10000.0) * w["consistency"]
        + (given(auc, 0.5) - 0.5) * 200.0 * w["auc"]
    )


def overfit_fitness(train, validation, threshold: float = 2.0) -> Column:
    t, v = F.coalesce(col(train), F.lit(0.0)), F.coalesce(col(validation), F.lit(0.0))
    return F.when(t - v > threshold, 0.5 * v).otherwise(0.7 * v + 0.3 * t)


def coefficient_of_variation(mean, std) -> Column:
    m, s = col(mean), col(std)
    return F.when(F.abs(m) > 0.001, s / F.abs(m)).when(s == 0, 0.0).otherwise(1e6)


def split_fitness(mean, std, objective: str = "mean_std", penalty: float = 1.0) -> Column:
    if objective == "mean_std":
        return col(mean) - penalty * col(std)
    if objective == "cv":
        return 100.0 - 100.0 * F.least(coefficient_of_variation(mean, std), F.lit(100.0))
    raise ValueError(f"unknown objective {objective!r}; use mean_std or cv")
