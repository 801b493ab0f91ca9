"""Probability and loss expressions over 3-class score columns.

Scores are carried as separate double columns (``z0, z1, z2``) so every
expression compiles to straight-line code; array variants exist where a
column holds a vector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: float64 machine epsilon, the clip used by the multiclass log loss.
EPS = 2.220446049250313e-16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(*zs, temperature=None) -> list[Column]:
    """Max-subtracted softmax of ``zs / temperature``."""
    zs = [_c(z) for z in zs]
    if temperature is not None:
        t = _c(temperature) if not isinstance(temperature, (int, float)) else F.lit(float(temperature))
        zs = [z / t for z in zs]
    m = F.greatest(*zs)
    es = [F.exp(z - m) for z in zs]
    tot = es[0]
    for e in es[1:]:
        tot = tot + e
    return [e / tot for e in es]


def pick(label, *ps) -> Column:
    """The entry of ``ps`` at index ``label`` (0-based)."""
    out = None
    for i, p in enumerate(ps):
        out = (F.when(_c(label) == i, _c(p)) if out is None else out.when(_c(label) == i, _c(p)))
    return out


def row_log_loss(label, *ps, eps: float = EPS) -> Column:
    """Clip to [eps, 1-eps], renormalise the row, ``-ln p_label``."""
    clipped = [F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps)) for p in ps]
    tot = clipped[0]
    for c in clipped[1:]:
        tot = tot + c
    return -F.ln(pick(label, *clipped) / tot)


def row_softmax_log_loss(label, *zs, temperature=None) -> Column:
    return row_log_loss(label, *softmax(*zs, temperature=temperature))


def argmax(*xs) -> Column:
    """M5: index of the first maximum."""
    arr = F.array(*[_c(x) for x in xs])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def cross_entropy(label, *zs) -> Column:
    """Per-row CE of logits (= softmax log loss without the clip)."""
    zs = [_c(z) for z in zs]
    m = F.greatest(*zs)
    lse = F.log(sum((F.exp(z - m) for z in zs[1:]), F.exp(zs[0] - m))) + m
    return lse - pick(label, *zs)


def smoothed_cross_entropy(label, *zs, smoothing: float = 0.1) -> Column:
    """``(1-s)·ce_y + s·mean_c(ce_c)``."""
    zs = [_c(z) for z in zs]
    ces = [cross_entropy(F.lit(i), *zs) for i in range(len(zs))]
    mean_ce = sum(ces[1:], ces[0]) / len(zs)
    return (1.0 - smoothing) * cross_entropy(label, *zs) + smoothing * mean_ce


def prior_adjust(ps, ws) -> list[Column]:
    """``p·w`` rescaled to the original total ``Σp``."""
    ps = [_c(p) for p in ps]
    ws = [_c(w) for w in ws]
    sp = sum(ps[1:], ps[0])
    swp = sum((w * p for w, p in zip(ws[1:], ps[1:])), ws[0] * ps[0])
    return [w * p * sp / swp for w, p in zip(ws, ps)]


def blend(ps, qs, w) -> list[Column]:
    """Convex combination ``w·p + (1-w)·q``."""
    w = _c(w) if not isinstance(w, (int, float)) else F.lit(float(w))
    return [w * _c(p) + (1 - w) * _c(q) for p, q in zip(ps, qs)]


def select_by_index(scores, idx: list[int]) -> list[Column]:
    """Pick entries of a score vector by 0-based index (NULL when out of range)."""
    return [F.get(_c(scores), i) for i in idx]
