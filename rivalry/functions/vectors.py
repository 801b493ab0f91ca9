"""Dense-vector expressions on ``array<float|double>`` columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product, folded in array order (double accumulator)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """Unit vector; the norm is floored at ``eps`` like the usual normalise op."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def to_double(a) -> Column:
    """Element cast (``array<float>`` → ``array<double>``)."""
    return _c(a).cast("array<double>")


def to_float(a) -> Column:
    return _c(a).cast("array<float>")


def round_vec(a, digits: int = 5) -> Column:
    return F.transform(_c(a), lambda x: F.round(x.cast("double"), digits))
