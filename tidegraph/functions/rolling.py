"""Rolling statistics over the current row and the rows before it.

Each function takes columns and a window of ``periods`` rows; nulls take up places but do not count, and a window
with fewer than ``min_samples`` values gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

INTERPOLATIONS = ("linear", "lower", "higher", "midpoint", "nearest", "equiprobable")
RANKS = ("average", "dense", "max", "min")


def gated(value: Column, x: Column, w: WindowSpec, min_samples: int) -> Column:
    return F.when(F.count(x).over(w) >= min_samples, value)


def mean(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return gated(F.avg(x).over(w), x, w, min_samples)


def total(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return gated(F.sum(x).over(w), x, w, min_samples)


def highest(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return gated(F.max(x).over(w), x, w, min_samples)


def lowest(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return gated(F.min(x).over(w), x, w, min_samples)


def variance(x: Column, w: WindowSpec, min_samples: int, ddof: int = 1) -> Column:
    n = F.count(x).over(w)
    if ddof == 1:
        value = F.var_samp(x).over(w)
    elif ddof == 0:
        value = F.var_pop(x).over(w)
    else:
        value = F.when(n > ddof, F.var_pop(x).over(w) * n / (n - ddof))
    return F.when((n >= min_samples) & (n > ddof), value)


def deviation(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return F.sqrt(variance(x, w, min_samples))


def z_score(x: Column, w: WindowSpec, min_samples: int) -> Column:
    s = deviation(x, w, min_samples)
    return F.when(s > 0, (x - mean(x, w, min_samples)) / s)


def quantile(x: Column, w: WindowSpec, min_samples: int, q: float, interpolation: str = "linear") -> Column:
    if interpolation == "linear":
        return gated(F.percentile(x, F.lit(q)).over(w), x, w, min_samples)
    values = F.array_sort(F.collect_list(x).over(w))
    at = (F.size(values) - 1) * F.lit(q)
    pick = lambda i: F.get(values, i.cast("int"))
    low, high = pick(F.floor(at)), pick(F.ceil(at))
    value = {
        "lower": low,
        "higher": high,
        "midpoint": (low + high) / 2,
        "nearest": pick(F.round(at)),
        "equiprobable": pick(F.greatest(F.lit(0), F.ceil(F.size(values) * F.lit(q)) - 1)),
    }[interpolation]
    return gated(value, x, w, min_samples)


def median(x: Column, w: WindowSpec, min_samples: int) -> Column:
    return quantile(x, w, min_samples, 0.5)


def percentile_rank(x: Column, w: WindowSpec, min_samples: int, method: str = "average") -> Column:
    """(rank - 1) / (count - 1) of the current value in its window; a single value ranks 0."""
    values = F.collect_list(x).over(w)
    below = F.size(F.filter(values, lambda v: v < x))
    upto = F.size(F.filter(values, lambda v: v <= x))
    rank = {
        "min": below + 1,
        "max": upto,
        "average": (below + 1 + upto) / 2,
        "dense": F.size(F.array_distinct(F.filter(values, lambda v: v < x))) + 1,
    }[method]
    n = F.count(x).over(w)
    return F.when(x.isNotNull() & (n >= min_samples), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)))


def covariance(x: Column, y: Column, w: WindowSpec, min_samples: int, ddof: int = 1) -> Column:
    """NaN counts as missing; a window in which any pair is incomplete gives null."""
    x, y = F.when(~F.isnan(x), x), F.when(~F.isnan(y), y)
    pair = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    n = F.count(pair).over(w)
    value = F.covar_samp(x, y).over(w) if ddof == 1 else F.covar_pop(x, y).over(w)
    if ddof > 1:
        value = value * n / F.when(n > ddof, n - ddof)
    return F.when((n >= min_samples) & (n == F.count(F.lit(1)).over(w)) & (n > ddof), value)


def covariance_matrix(columns: list[Column], w: WindowSpec, min_samples: int, ddof: int = 1) -> Column:
    """Row-major n x n array; the upper triangle is computed once."""
    n = len(columns)
    cell = {}
    for i in range(n):
        cell[i, i] = variance(F.when(~F.isnan(columns[i]), columns[i]), w, min_samples, ddof)
        for j in range(i + 1, n):
            cell[i, j] = cell[j, i] = covariance(columns[i], columns[j], w, min_samples, ddof)
    return F.array(*[cell[i, j] for i in range(n) for j in range(n)])
