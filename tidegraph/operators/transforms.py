"""Element-wise, shift, rolling, packing and exponentially weighted transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tidegraph.functions import rolling, scalar
from tidegraph.operators.base import Operator, operation, positive
from tidegraph.plans.types import ColumnSignature, FrameSignature

_NUMERIC = ("bool", "float32", "float64", "int8", "int16", "int32", "int64")


@dataclass(frozen=True)
class Unary(Operator):
    """One input, one output of the same type."""

    input_column: str = "value"
    output_column: str = "value"
    timestamp_column: str = "timestamp"

    def inputs(self):
        return [self.input_column]

    def outputs(self, given):
        return FrameSignature((given[self.input_column].named(self.output_column),))

    def function(self, x):
        raise NotImplementedError

    def columns(self, given, kinds, over):
        return [scalar.elementwise(self.function, bool(kinds[self.input_column].shape))(given[self.input_column])]


def _unary(name: str, function, text: str):
    cls = type(name, (Unary,), {"function": lambda self, x: function(x), "__doc__": text, "__module__": __name__})
    return operation("transform")(dataclass(frozen=True)(cls))


Abs = _unary("Abs", scalar.absolute, "Absolute value.")
Sign = _unary("Sign", scalar.sign, "-1, 0 or 1.")
Sqrt = _unary("Sqrt", scalar.sqrt, "Square root; negative values give null.")
Log = _unary("Log", scalar.log, "Natural logarithm of positive values, else null.")
Exp = _unary("Exp", scalar.exp, "e to the power of the value.")
Logit = _unary("Logit", scalar.logit, "Log odds of values between 0 and 1, else null.")
Negate = _unary("Negate", scalar.negate, "Minus the value.")


@operation("transform")
@dataclass(frozen=True)
class Power(Unary):
    """The value to a fixed power; results that are not finite are null."""

    exponent: float = 2.0

    def __post_init__(self):
        scalar.finite(self.exponent, "exponent")

    def function(self, x):
        return scalar.power(x, self.exponent)


@operation("transform")
@dataclass(frozen=True)
class Clip(Unary):
    """The value, not below ``lower`` nor above ``upper``; NaN stays."""

    lower: float | None = None
    upper: float | None = None

    def __post_init__(self):
        bounds = [scalar.finite(b, "a bound") for b in (self.lower, self.upper) if b is not None]
        if not bounds or bounds != sorted(bounds):
            raise ValueError("clip needs bounds in order")

    def function(self, x):
        return scalar.clip(x, self.lower, self.upper)


@dataclass(frozen=True)
class Binary(Operator):
    """Two inputs of one type, one output of it."""

    left_column: str = "left"
    right_column: str = "right"
    output_column: str = "value"
    timestamp_column: str = "timestamp"

    def inputs(self):
        return [self.left_column, self.right_column]

    def outputs(self, given):
        a, b = given[self.left_column], given[self.right_column]
        if a.shape != b.shape:
            raise ValueError(f"shapes differ: {a.shape} and {b.shape}")
        return FrameSignature((a.named(self.output_column),))

    def function(self, a, b):
        raise NotImplementedError

    def columns(self, given, kinds, over):
        a, b = self.inputs()
        return [scalar.pairwise(self.function, bool(kinds[a].shape))(given[a], given[b])]


@operation("transform")
@dataclass(frozen=True)
class Spread(Binary):
    """Left minus right."""

    def function(self, a, b):
        return scalar.spread(a, b)


@operation("transform")
@dataclass(frozen=True)
class Product(Binary):
    """Left times right."""

    def function(self, a, b):
        return scalar.product(a, b)


@dataclass(frozen=True)
class _Quotient(Operator):
    numerator_column: str = "left"
    denominator_column: str = "right"
    output_column: str = "value"
    timestamp_column: str = "timestamp"

    def inputs(self):
        return [self.numerator_column, self.denominator_column]

    outputs = lambda self, given: Binary(self.numerator_column, self.denominator_column, self.output_column).outputs(given)


@operation("transform")
@dataclass(frozen=True)
class Ratio(_Quotient):
    """Numerator over denominator; infinite quotients are null, 0/0 is NaN."""

    def columns(self, given, kinds, over):
        a, b = self.inputs()
        return [scalar.pairwise(scalar.ratio, bool(kinds[a].shape))(given[a], given[b])]


@operation("transform")
@dataclass(frozen=True)
class LogRatio(_Quotient):
    """Logarithm of the quotient of positive numbers, else null; in arrays the quotient's sign decides."""

    def columns(self, given, kinds, over):
        a, b = self.inputs()
        if kinds[a].shape:
            return [F.zip_with(given[a], given[b], scalar.log_ratio_element)]
        return [scalar.log_ratio(given[a], given[b])]


@dataclass(frozen=True)
class _Shift(Unary):
    periods: int = 1

    def __post_init__(self):
        positive(self.periods, "periods")

    def halo(self):
        return self.periods, 0

    def columns(self, given, kinds, over):
        x = given[self.input_column]
        return [self.shifted(x, F.lag(x, self.periods).over(over()), kinds[self.input_column])]

    def shifted(self, x, prior, kind):
        raise NotImplementedError


@operation("transform", "0.2.0")
@dataclass(frozen=True)
class Lag(_Shift):
    """The value ``periods`` rows earlier; of an array, nulls where there is none."""

    def shifted(self, x, prior, kind):
        return F.coalesce(prior, F.array_repeat(F.lit(None).cast("double"), kind.width)) if kind.shape else prior


@operation("transform")
@dataclass(frozen=True)
class Lead(_Shift):
    """The value ``periods`` rows later: it looks ahead."""

    LOOKAHEAD = True

    def halo(self):
        return 0, self.periods

    def trailing_rows(self):
        return 0

    def columns(self, given, kinds, over):
        return [F.lead(given[self.input_column], self.periods).over(over())]


@operation("transform", "0.2.0")
@dataclass(frozen=True)
class Delta(_Shift):
    """The value less that of ``periods`` rows earlier."""

    def shifted(self, x, prior, kind):
        return F.zip_with(x, F.coalesce(prior, F.array_repeat(F.lit(None).cast("double"), kind.width)), scalar.spread) if kind.shape else x - prior


@dataclass(frozen=True)
class _ScalarShift(_Shift):
    def accepts(self, name, given):
        return super().accepts(name, given) or (f"{name} must be scalar" if given.shape else None)


@operation("transform")
@dataclass(frozen=True)
class PctChange(_ScalarShift):
    """The value over that of ``periods`` rows earlier, less 1; null over zero or if infinite."""

    def shifted(self, x, prior, kind):
        return scalar.pct_change(x, prior)


@operation("transform")
@dataclass(frozen=True)
class LogReturn(_ScalarShift):
    """Difference of logarithms of positive values, else null."""

    def shifted(self, x, prior, kind):
        return scalar.log_return(x, prior)


@dataclass(frozen=True)
class Rolling(Unary):
    """A statistic of the last ``periods`` rows with at least ``min_samples`` values."""

    periods: int = 3
    min_samples: int = 1

    def __post_init__(self):
        positive(self.periods, "periods")
        positive(self.min_samples, "min_samples")
        if self.min_samples > self.periods:
            raise ValueError("min_samples can't exceed periods")

    def accepts(self, name, given):
        return super().accepts(name, given) or (f"{name} must be scalar" if given.shape else None)

    def halo(self):
        return self.periods, 0

    def statistic(self, x, w):
        raise NotImplementedError

    def columns(self, given, kinds, over):
        return [self.statistic(given[self.input_column], over(self.periods - 1))]


def _rolling(name: str, function, text: str):
    cls = type(name, (Rolling,), {"statistic": lambda self, x, w: function(x, w, self.min_samples), "__doc__": text, "__module__": __name__})
    return operation("transform")(dataclass(frozen=True)(cls))


RollingMean = _rolling("RollingMean", rolling.mean, "Mean.")
RollingSum = _rolling("RollingSum", rolling.total, "Sum.")
RollingMax = _rolling("RollingMax", rolling.highest, "Largest value.")
RollingMin = _rolling("RollingMin", rolling.lowest, "Smallest value.")
RollingStd = _rolling("RollingStd", rolling.deviation, "Sample standard deviation.")
RollingMedian = _rolling("RollingMedian", rolling.median, "Median.")
RollingZScore = _rolling("RollingZScore", rolling.z_score, "Distance to the mean in standard deviations; null where they are 0.")


def _check_ddof(ddof: int, periods: int) -> None:
    positive(ddof, "ddof", 0)
    if ddof >= periods:
        raise ValueError("ddof must be less than periods")


@operation("transform")
@dataclass(frozen=True)
class RollingVar(Rolling):
    """Variance with ``ddof`` lost degrees of freedom."""

    ddof: int = 1

    def __post_init__(self):
        super().__post_init__()
        _check_ddof(self.ddof, self.periods)

    def statistic(self, x, w):
        return rolling.variance(x, w, self.min_samples, self.ddof)


@operation("transform")
@dataclass(frozen=True)
class RollingQuantile(Rolling):
    """A quantile, by one of six rules between values."""

    quantile: float = 0.5
    interpolation: str = "linear"

    def __post_init__(self):
        super().__post_init__()
        if not 0 <= self.quantile <= 1:
            raise ValueError("quantile must be between 0 and 1")
        if self.interpolation not in rolling.INTERPOLATIONS:
            raise ValueError(f"interpolation must be one of {rolling.INTERPOLATIONS}")

    def statistic(self, x, w):
        return rolling.quantile(x, w, self.min_samples, self.quantile, self.interpolation)


@operation("transform")
@dataclass(frozen=True)
class RollingPercentileRank(Rolling):
    """Where the current value stands in its window, from 0 to 1."""

    method: str = "average"

    def __post_init__(self):
        super().__post_init__()
        if self.method not in rolling.RANKS:
            raise ValueError(f"method must be one of {rolling.RANKS}")

    def statistic(self, x, w):
        return rolling.percentile_rank(x, w, self.min_samples, self.method)


@operation("transform")
@dataclass(frozen=True)
class RollingCov(Binary):
    """Covariance of two inputs; any incomplete pair in the window gives null."""

    periods: int = 3
    min_samples: int = 1
    ddof: int = 1

    def __post_init__(self):
        Rolling(periods=self.periods, min_samples=self.min_samples)
        _check_ddof(self.ddof, self.periods)

    def halo(self):
        return self.periods, 0

    def columns(self, given, kinds, over):
        a, b = self.inputs()
        return [rolling.covariance(given[a], given[b], over(self.periods - 1), self.min_samples, self.ddof)]


@operation("transform")
@dataclass(frozen=True)
class RollingCovMatrix(Operator):
    """Covariances of all pairs of inputs, row by row in one array."""

    input_columns: tuple[str, ...] = ()
    output_column: str = "value"
    periods: int = 3
    min_samples: int = 1
    ddof: int = 1
    timestamp_column: str = "timestamp"

    def __post_init__(self):
        object.__setattr__(self, "input_columns", tuple(self.input_columns))
        if len(self.input_columns) < 2 or len(set(self.input_columns)) < len(self.input_columns):
            raise ValueError("input_columns must be two or more different names")
        Rolling(periods=self.periods, min_samples=self.min_samples)
        _check_ddof(self.ddof, self.periods)

    def inputs(self):
        return list(self.input_columns)

    def halo(self):
        return self.periods, 0

    def outputs(self, given):
        n = len(self.input_columns)
        return FrameSignature((ColumnSignature(self.output_column, "float64", (n, n)),))

    def columns(self, given, kinds, over):
        return [rolling.covariance_matrix([given[c] for c in self.input_columns], over(self.periods - 1), self.min_samples, self.ddof)]


@operation("transform", "0.2.0")
@dataclass(frozen=True)
class FeaturePacker(Operator):
    """Scalars and arrays, in declared order, in one array; missing parts are null elements."""

    input_columns: tuple[str, ...] = ()
    output_column: str = "features"
    output_dtype: str = "float64"
    timestamp_column: str = "timestamp"

    def __post_init__(self):
        object.__setattr__(self, "input_columns", tuple(self.input_columns))
        if not self.input_columns or len(set(self.input_columns)) < len(self.input_columns):
            raise ValueError("input_columns must be one or more different names")
        if self.output_dtype not in ("float32", "float64"):
            raise ValueError("output_dtype must be float32 or float64")

    def inputs(self):
        return list(self.input_columns)

    def accepts(self, name, given):
        return None if given.dtype in _NUMERIC else f"{name} must be a number or boolean, not {given.dtype}"

    def outputs(self, given):
        return FrameSignature((ColumnSignature(self.output_column, self.output_dtype, (sum(given[c].width if given[c].shape else 1 for c in self.input_columns),)),))

    def columns(self, given, kinds, over):
        kind = "float" if self.output_dtype == "float32" else "double"
        parts = []
        for c in self.input_columns:
            if kinds[c].shape:
                none = F.array_repeat(F.lit(None).cast(kind), kinds[c].width)
                parts.append(F.coalesce(F.transform(given[c], lambda e: e.cast("int").cast(kind) if kinds[c].dtype == "bool" else e.cast(kind)), none))
            else:
                parts.append(F.array(given[c].cast("int").cast(kind) if kinds[c].dtype == "bool" else given[c].cast(kind)))
        return [F.concat(*parts)]


@operation("transform")
@dataclass(frozen=True)
class FeatureUnpacker(Operator):
    """An array's elements as columns ``base_0``, ``base_1`` and so on."""

    input_column: str = "features"
    base_name: str = "feature"
    features: int | None = None
    timestamp_column: str = "timestamp"

    def inputs(self):
        return [self.input_column]

    def accepts(self, name, given):
        if not given.shape or given.dtype not in ("float32", "float64"):
            return f"{name} must be an array of floats"
        return f"{name} has {given.width} elements, not {self.features}" if self.features not in (None, given.width) else None

    def outputs(self, given):
        return FrameSignature(tuple(ColumnSignature(f"{self.base_name}_{i}") for i in range(given[self.input_column].width)))

    def columns(self, given, kinds, over):
        x = given[self.input_column]
        return [F.get(x, i).cast("double") for i in range(kinds[self.input_column].width)]
