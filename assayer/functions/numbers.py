"""Number functions: distributions as arrays of probabilities in option order, losses, bounds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Floors of logarithms, the 90 % one-sided normal quantile.
EPS, TINY, Z90 = 1e-6, 1e-12, 1.2816


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalized(p: Column) -> Column:
    """Shares of the sum; uniform if that isn't positive."""
    return F.when(total(p) > 0, F.transform(p, lambda x: x / total(p))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def smoothed(p: Column, share: float) -> Column:
    return F.transform(p, lambda x: x * (1 - share) + F.lit(share) / F.size(p))


def tempered(p: Column, t: Column | float) -> Column:
    """p^(1/t), normalised."""
    t = F.lit(t) if isinstance(t, float) else t
    return normalized(F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(TINY)), 1 / t)))


def first_largest(p: Column) -> Column:
    """The place, from 1, of the first largest entry."""
    return F.array_position(p, F.array_max(p)).cast("int")


def log_loss(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(EPS)))


def wilson_upper(errors: Column, n: Column, z: float = Z90) -> Column:
    """The one-sided upper bound of an error rate; 1 without observations."""
    rate, zz = errors / n, z * z
    root = F.sqrt(rate * (1 - rate) / n + zz / (4 * n * n))
    return F.when(n > 0, F.least(F.lit(1.0), (rate + zz / (2 * n) + z * root) / (1 + zz / n))).otherwise(1.0)


def hoeffding(value_range: Column | float, delta: float, n: Column) -> Column:
    r = F.lit(value_range) if isinstance(value_range, float) else value_range
    return F.sqrt(r * r * F.ln(F.lit(1 / delta)) / (2 * n))


def entropy(counts: list[Column]) -> Column:
    """In bits, of class counts given as columns."""
    n = sum(counts[1:], counts[0])
    part = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    return sum((part(c) for c in counts[1:]), part(counts[0]))
