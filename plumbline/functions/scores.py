"""Vector and evaluation scores as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def unit(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def recall_at(retrieved: Column, expected: Column, k: Column) -> Column:
    """The share of distinct expected items among the first k retrieved; null where nothing is expected."""
    return F.try_divide(F.size(F.array_intersect(F.slice(retrieved, F.lit(1), k), expected)), F.nullif(F.size(F.array_distinct(expected)), F.lit(0)))


def first_hit(retrieved: Column, expected: Column) -> Column:
    """The rank from 1 of the first expected item, null where there is none."""
    hits = F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    return F.array_min(hits)


def sign_test(wins: Column, losses: Column) -> Column:
    """The exact two-sided p of a sign test; null without a win or loss."""
    n, least = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("total"))
    step = lambda acc, i: F.struct((acc["c"] * (n - i + 1) / i).alias("c"), (acc["total"] + acc["c"] * (n - i + 1) / i).alias("total"))
    counts = F.when(least > 0, F.sequence(F.lit(1), least.cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(counts, start, step, lambda acc: acc["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total / F.pow(F.lit(2.0), n)))


def token_cost(inputs: Column, outputs: Column, in_price: Column, out_price: Column) -> Column:
    """USD of a call at prices per million tokens; null where a price or count is."""
    return (inputs * in_price + outputs * out_price) / 1e6
