"""Row-wise score functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(score: Column, threshold: float) -> Column:
    """Inclusive decision rule as 0/1."""
    return (score >= F.lit(float(threshold))).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def sigmoid(margin: Column) -> Column:
    """Logistic function with the margin held inside +-50."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(margin, -50, 50)))


def prior_logit(rate: Column) -> Column:
    """Log-odds of a base rate held inside [1e-6, 1 - 1e-6]."""
    p = clip(rate, 1e-6, 1 - 1e-6)
    return F.log(p / (F.lit(1.0) - p))


def rescale(score: Column, low: float, high: float) -> Column:
    """Map [low, high] to [0, 1]; a constant score becomes 0.5."""
    if high > low:
        return (score - F.lit(low)) / F.lit(high - low)
    return F.when(score.isNotNull(), F.lit(0.5))


def with_rescaled(df: DataFrame, score: str, out: str) -> DataFrame:
    """Add the min-max rescaled score; the range is one aggregate row."""
    low, high = df.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, rescale(F.col(score), low, high))


def tanh_to_probability(score: Column) -> Column:
    """Map a [-1, 1] score to a probability."""
    return clip((score + 1.0) / 2.0, 0, 1)


def cross_entropy(label: Column, probability: Column, eps: float = 1e-7) -> Column:
    """Binary cross-entropy of one row, probability held inside [eps, 1 - eps]."""
    p = clip(probability, eps, 1 - eps)
    y = label.cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def focal_loss(margin: Column, label: Column, gamma: float, alpha: float) -> Column:
    """-a (1 - pt)^gamma ln(pt), pt the probability of the row's own class, a its class weight."""
    _, pt, weight = _focal_terms(margin, label, alpha)
    return -weight * F.pow(1.0 - pt, F.lit(gamma)) * F.log(pt)


def focal_slope(margin: Column, label: Column, gamma: float, alpha: float) -> Column:
    """The derivative of ``focal_loss`` in the margin: +-a (1 - pt)^gamma (gamma pt ln(pt) - (1 - pt))."""
    _, pt, weight = _focal_terms(margin, label, alpha)
    towards = F.when(label == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return towards * weight * F.pow(1.0 - pt, F.lit(gamma)) * (gamma * pt * F.log(pt) - (1.0 - pt))


def focal_bend(margin: Column, label: Column, gamma: float, alpha: float) -> Column:
    """The second derivative, held above a tenth of the curvature of the weighted log loss, as it can be negative."""
    _, pt, weight = _focal_terms(margin, label, alpha)
    rest = 1.0 - pt
    inner = -gamma * F.pow(rest, F.lit(gamma - 1.0)) * (gamma * pt * F.log(pt) - rest)
    outer = F.pow(rest, F.lit(gamma)) * (gamma * F.log(pt) + gamma + 1.0)
    return F.greatest(weight * (inner + outer) * pt * rest, 0.1 * weight * pt * rest, F.lit(1e-6))


def focal_gradient(margin: Column, label: Column, gamma: float, alpha: float) -> Column:
    """Gradient of the scripted focal objectives (fixed formula: scores must equal theirs)."""
    p, pt, weight = _focal_terms(margin, label, alpha)
    y = label.cast("double")
    modulation = F.pow(1.0 - pt, F.lit(gamma))
    slope = F.signum(p - y) * gamma * F.pow(1.0 - pt, F.lit(gamma - 1.0)) * pt
    return weight * (modulation * (p - y) + slope * (-F.log(pt)) * pt)


def focal_hessian(margin: Column, label: Column, gamma: float, alpha: float) -> Column:
    """Their positive curvature surrogate, never below 1e-6 (fixed formula)."""
    p, pt, weight = _focal_terms(margin, label, alpha)
    modulation = F.pow(1.0 - pt, F.lit(gamma))
    curvature = modulation * p * (1.0 - p) * (1.0 + gamma * pt)
    return F.greatest(weight * curvature, F.lit(1e-6))


def _focal_terms(margin: Column, label: Column, alpha: float):
    p = clip(sigmoid(margin), 1e-9, 1 - 1e-9)
    positive = label == 1
    pt = F.when(positive, p).otherwise(1.0 - p)
    weight = F.when(positive, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return p, pt, weight


def weighted_mean(columns: list[str], weights: list[float] | None = None) -> Column:
    """Weighted mean of score columns; equal weights if none are given."""
    w = [1.0] * len(columns) if weights is None else [float(x) for x in weights]
    total = sum(w)
    return reduce(add, [F.col(c) * F.lit(x / total) for c, x in zip(columns, w)])
