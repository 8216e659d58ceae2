"""Vector arithmetic in double precision on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no direction."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def score(metric: str, a: Column, b: Column, compat: bool = False) -> Column:
    """Higher is better.  compat gives the raw squared distance for whatever is not cosine."""
    if metric == "cosine":
        return cosine(a, b)
    if compat:
        return squared_l2(a, b)
    return {"dot": dot, "euclid": lambda x, y: -F.sqrt(squared_l2(x, y))}.get(metric, cosine)(a, b)
