"""Expressions on class-score arrays (ARRAY<DOUBLE>); all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def log_sum_exp(xs: Column) -> Column:
    """log(sum(exp(x))), safe for large and -inf values; -inf if all are."""
    top = F.array_max(xs)
    sum_ = total(F.transform(xs, lambda x: F.exp(x - top)))
    return F.when(top == float("-inf"), top).otherwise(top + F.log(sum_))


def softmax(xs: Column) -> Column:
    """Probabilities of log scores."""
    return F.transform(log_softmax(xs), lambda x: F.exp(x))


def log_softmax(xs: Column) -> Column:
    """Log probabilities of log scores."""
    return F.zip_with(xs, F.array_repeat(log_sum_exp(xs), F.size(xs)), lambda x, z: x - z)


def sigmoid(xs: Column) -> Column:
    """1 / (1 + exp(-x)) of each score."""
    return F.transform(xs, lambda x: 1 / (1 + F.exp(-x)))


def signed_probs(xs: Column) -> Column:
    """2 p - 1 of each probability."""
    return F.transform(xs, lambda x: 2 * x - 1)


def argmax(xs: Column) -> Column:
    """Position of the largest value, the first on a tie, from 0; null for an empty array."""
    return F.when(F.size(xs) > 0, (F.array_position(xs, F.array_max(xs)) - 1).cast("int"))


def suppress_nonmax(xs: Column, other: float = 0.0) -> Column:
    """All but the first largest value replaced."""
    best = argmax(xs)
    return F.transform(xs, lambda x, i: F.when(i == best, x).otherwise(F.lit(other)))


def assign_to_mode(xs: Column, among: list[int] | None = None) -> Column:
    """The distribution moved to its mode; unchanged if the mode isn't in ``among``."""
    best = argmax(xs)
    hard = F.transform(xs, lambda x, i: F.when(i == best, F.lit(1.0)).otherwise(F.lit(0.0)))
    return hard if among is None else F.when(best.isin(among), hard).otherwise(xs)


def pick(xs: Column, ids: list[int]) -> Column:
    """The scores at these positions, in this order; positions may repeat."""
    return F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.get(xs, i))


def prune(xs: Column, k: int) -> Column:
    """Scores below the (k + 1)-th best distinct value become -inf."""
    distinct = F.sort_array(F.array_distinct(xs), asc=False)
    limit = F.get(distinct, F.least(F.lit(k), F.size(distinct) - 1))
    return F.transform(xs, lambda x: F.when(x >= limit, x).otherwise(F.lit(float("-inf"))))


def beam(xs: Column, threshold: float) -> Column:
    """Whether each score lies within ``threshold`` (negative) of the best."""
    return F.transform(xs, lambda x: x >= F.array_max(xs) + threshold)


def add(xs: Column, ys: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(xs, ys, lambda x, y: x + y)


def dot(xs: Column, ys: Column) -> Column:
    """Inner product."""
    return total(F.zip_with(xs, ys, lambda x, y: x * y))


def rounded(xs: Column, places: int = 6) -> Column:
    """Each value rounded."""
    return F.transform(xs, lambda x: F.round(x, places))
