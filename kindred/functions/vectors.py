"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a stopword or one-byte word weighs in a combined vector.
STOP_WEIGHT = 0.25


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; null for the zero vector."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def subtract(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a - b)


def cosine_distance(u: Column, v: Column) -> Column:
    """1 less the cosine, which counts from 0 to 1; null if either vector is zero."""
    size = norm(u) * norm(v)
    return F.when(size > 0, 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(u, v) / size)))


def weight(relevance: Column, stop: Column) -> Column:
    return F.when(stop, relevance * STOP_WEIGHT).otherwise(relevance)


def weighted_sum(pairs: Column) -> Column:
    """Sum of weight times vec over an array of struct<vec, w>; entries without vec don't count."""
    known = F.filter(pairs, lambda p: p["vec"].isNotNull())
    first = F.transform(F.get(known, F.lit(0))["vec"], lambda x: x * 0.0)
    return F.aggregate(known, first, lambda s, p: F.zip_with(s, p["vec"], lambda a, b: a + b * p["w"]))
