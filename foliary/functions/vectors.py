"""Vector expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine distance to a fixed query vector; null for null vectors."""
    q = [float(x) for x in query]
    q_norm = math.sqrt(sum(x * x for x in q))
    literal = F.array(*[F.lit(x) for x in q])
    return dot(vector, literal) / (norm(vector) * F.lit(q_norm))
