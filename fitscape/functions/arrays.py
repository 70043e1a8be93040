"""Array columns: one-hot, radial basis, softmax, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(index: Column, size: int = 20) -> Column:
    """Zeros but for `index`; all zeros for -1 or null."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce((i == index).cast("double"), F.lit(0.0)))


def rbf(distance: Column, lo: float = 2.0, hi: float = 12.0, n: int = 6) -> Column:
    """exp(-(d - c)^2 / s^2) at n centres from lo to hi, s = (hi - lo) / n."""
    centres = [F.lit(lo + k * (hi - lo) / (n - 1)) for k in range(n)]
    s = (hi - lo) / n
    return F.array(*[F.exp(-((distance - c) * (distance - c)) / F.lit(s * s)) for c in centres])


def softmax(logits: Column) -> Column:
    """Stable softmax of an array."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def log_softmax(logits: Column) -> Column:
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(logits)))
    return F.transform(logits, lambda x: x - F.array_max(logits) - F.log(total))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of arrays of three."""
    d = [F.get(a, F.lit(k)) - F.get(b, F.lit(k)) for k in range(3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for a row however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
