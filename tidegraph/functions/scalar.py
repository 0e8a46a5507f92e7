"""Element-wise functions with exact rules for null and NaN, for scalar and for array columns.

Null means missing and stays null; NaN is a value.  No function depends on the session's ANSI setting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_POSITIVE, _NEGATIVE = float("inf"), float("-inf")


def _nan() -> Column:
    return F.lit(float("nan"))


def drop_infinite(x: Column) -> Column:
    return F.when((x != F.lit(_POSITIVE)) & (x != F.lit(_NEGATIVE)), x)


def drop_nonfinite(x: Column) -> Column:
    return F.when(~F.isnan(x), drop_infinite(x))


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, exponent: float) -> Column:
    return drop_nonfinite(F.pow(x, F.lit(float(exponent))))


def clip(x: Column, lower: float | None, upper: float | None) -> Column:
    out = x
    if upper is not None:
        out = F.when((x > F.lit(float(upper))) & ~F.isnan(x), F.lit(float(upper))).otherwise(out)
    if lower is not None:
        out = F.when(x < F.lit(float(lower)), F.lit(float(lower))).otherwise(out)
    return out


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def exp(x: Column) -> Column:
    return F.exp(x)


def logit(x: Column) -> Column:
    return F.when((x > 0) & (x < 1), F.ln(x / (F.lit(1.0) - x)))


def negate(x: Column) -> Column:
    return -x


def spread(left: Column, right: Column) -> Column:
    return left - right


def product(left: Column, right: Column) -> Column:
    return left * right


def divide(n: Column, d: Column) -> Column:
    """IEEE division, whatever the ANSI setting: x/0 is infinite or NaN, not an error."""
    by_zero = F.when((n == 0) | F.isnan(n), _nan()).when(n > 0, F.lit(_POSITIVE)).when(n < 0, F.lit(_NEGATIVE))
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def ratio(n: Column, d: Column) -> Column:
    return F.when((d == 0) & ((n == 0) | F.isnan(n)), _nan()).otherwise(drop_infinite(F.try_divide(n, d)))


def log_ratio(n: Column, d: Column) -> Column:
    return F.when((n > 0) & (d > 0), drop_nonfinite(F.ln(F.try_divide(n, d))))


def log_ratio_element(n: Column, d: Column) -> Column:
    """In arrays only the quotient's sign counts: (-a) / (-b) has a logarithm."""
    return drop_nonfinite(F.ln(F.try_divide(n, d)))


def pct_change(x: Column, prior: Column) -> Column:
    return drop_infinite(F.try_divide(x, prior) - F.lit(1.0))


def log_return(x: Column, prior: Column) -> Column:
    return F.when((x > 0) & (prior > 0), F.ln(x) - F.ln(prior))


def elementwise(function, shaped: bool):
    """A unary function for a column of the given kind."""
    return (lambda x: F.transform(x, function)) if shaped else function


def pairwise(function, shaped: bool):
    """A binary function; arrays are combined element by element."""
    return (lambda a, b: F.zip_with(a, b, function)) if shaped else function


def finite(value: float, name: str) -> float:
    if not math.isfinite(value):
        raise ValueError(f"{name} must be finite")
    return float(value)
