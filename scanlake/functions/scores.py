"""Model-side arithmetic on logits, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(p: Column) -> Column:
    """The lowest index of the largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def cross_entropy(z: Column, y: Column) -> Column:
    top = F.array_max(z)
    total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.log(total) + top - F.element_at(z, (y + 1).cast("int"))


def bce_with_logits(z: Column, t: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
