"""Per-row losses over ``array<double>`` logits, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evaluation.
SMOOTHING = 0.04
HUBER_SCALE = 20.0
HUBER_DELTA = 10.0
COMPARISON = {"policy": 1.0, "value": 1.6, "moves_left": 0.5}


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _doubles(logits) -> Column:
    return _col(logits).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside array lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_exp(logits) -> Column:
    values = _doubles(logits)

    def shifted(v: Column) -> Column:
        return v["top"] + F.log(F.aggregate(v["x"], F.lit(0.0), lambda acc, x: acc + F.exp(x - v["top"])))

    return let(F.struct(values.alias("x"), F.array_max(values).alias("top")), shifted)


def cross_entropy(logits, target) -> Column:
    """−log softmax at the target class."""
    return log_sum_exp(logits) - F.element_at(_doubles(logits), _col(target).cast("int") + 1)


def smoothed_cross_entropy(logits, target, smoothing: float = SMOOTHING) -> Column:
    """Cross-entropy against 1−s on the target and s/(K−1) on every other class."""
    values = _doubles(logits)
    classes = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    hit = F.element_at(values, _col(target).cast("int") + 1)
    rest = F.lit(smoothing) / (classes - 1)
    # the weights sum to one, so the normaliser enters once
    return log_sum_exp(values) - (F.lit(1.0 - smoothing) * hit + rest * (total - hit))


def scaled_huber(prediction, target, scale: float = HUBER_SCALE, delta: float = HUBER_DELTA) -> Column:
    """Huber loss of values divided by ``scale``, linear beyond ``delta / scale``."""
    edge = delta / scale
    gap = F.abs(_col(prediction).cast("double") - _col(target).cast("double")) / F.lit(scale)
    return F.when(gap <= edge, gap * gap * 0.5).otherwise(F.lit(edge) * (gap - 0.5 * edge))


def _finite_or_zero(loss: Column) -> Column:
    return let(loss, lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x))


def masked_policy_loss(logits, legal, target) -> Column:
    """Policy loss from sparse legal indices and one target index.

    Softmax runs over the legal entries only, over all where the list is NULL. Target mass
    on an illegal index is dropped; no legal move gives 0.
    """
    values = _doubles(logits)
    every = F.transform(values, lambda _, i: i)
    allowed = F.coalesce(_col(legal).cast("array<int>"), every)
    index = _col(target).cast("int")
    both = F.struct(values.alias("x"), allowed.alias("i"))
    picked = let(both, lambda b: F.transform(b["i"], lambda i: F.element_at(b["x"], i + 1)))
    loss = log_sum_exp(picked) - F.element_at(values, index + 1)
    usable = (F.size(allowed) > 0) & F.coalesce(F.array_contains(allowed, F.coalesce(index, F.lit(-1))), F.lit(False))
    return _finite_or_zero(F.when(usable, loss).otherwise(0.0))


def dense_policy_loss(logits, targets) -> Column:
    """Policy loss from a dense target array in which negative entries mark illegal moves."""
    pairs = F.filter(F.arrays_zip(_doubles(logits).alias("x"), _doubles(targets).alias("t")), lambda p: p["t"] >= 0)
    mass = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["t"])
    hit = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["t"] * p["x"])
    loss = mass * log_sum_exp(F.transform(pairs, lambda p: p["x"])) - hit
    return _finite_or_zero(F.when(F.size(pairs) > 0, loss).otherwise(0.0))


def weighted_sum(weights: dict[str, float | Column]) -> Column:
    """Σ weight × column."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + (weight if isinstance(weight, Column) else F.lit(float(weight))) * F.col(name)
    return total
