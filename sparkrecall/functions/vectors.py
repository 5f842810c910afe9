"""Array<double> vector expressions (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Added to the norm product in the reference cosine.
COSINE_EPS = 1e-8


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(F.transform(_c(v), lambda x: x * 0.0))


def cosine(a, b, eps: float = COSINE_EPS) -> Column:
    """dot(a, b) / (|a| |b| + eps)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def sq_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)
