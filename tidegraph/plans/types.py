"""Declared schemas: the time axis and typed, possibly fixed-shape, value columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The schema language's names of types.
DTYPES = {
    "bool": T.BooleanType(), "float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "datetime": T.TimestampNTZType(), "datetime_tz": T.TimestampType(), "date": T.DateType(),
}
RESERVED = "delta_t"


@dataclass(frozen=True)
class TimeAxis:
    """The one time column of a frame."""

    column: str = "timestamp"
    dtype: str = "datetime"
    timezone: str | None = None

    def __post_init__(self):
        if self.timezone and self.dtype not in ("datetime", "datetime_tz"):
            raise ValueError("only a datetime axis has a time zone")
        if self.timezone:
            object.__setattr__(self, "dtype", "datetime_tz")


@dataclass(frozen=True)
class ColumnSignature:
    """A value column; a shaped one is stored flat, as an array of ``width`` elements."""

    name: str
    dtype: str = "float64"
    shape: tuple[int, ...] = ()

    @property
    def width(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(DTYPES[self.dtype]) if self.shape else DTYPES[self.dtype]

    def named(self, name: str) -> ColumnSignature:
        return ColumnSignature(name, self.dtype, self.shape)

    def same_type(self, other: ColumnSignature) -> bool:
        return (self.dtype, self.shape) == (other.dtype, other.shape)


@dataclass(frozen=True)
class FrameSignature:
    """Ordered, uniquely named value columns behind one time axis."""

    columns: tuple[ColumnSignature, ...] = ()
    time: TimeAxis = field(default_factory=TimeAxis)

    def __post_init__(self):
        fixed = tuple(c if isinstance(c, ColumnSignature) else ColumnSignature(*c) for c in self.columns)
        object.__setattr__(self, "columns", fixed)
        names = [c.name for c in fixed]
        if len(set(names)) < len(names):
            raise ValueError("column names must be unique")
        if self.time.column in names or RESERVED in names:
            raise ValueError(f"{self.time.column} and {RESERVED} can't be value columns")

    def __getitem__(self, name: str) -> ColumnSignature:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @classmethod
    def parse(cls, declared: dict) -> FrameSignature:
        """From ``{time: column, columns: {name: dtype | {dtype, shape}}}``."""
        unknown = set(declared) - {"time", "columns", "timezone", "time_dtype"}
        if unknown:
            raise ValueError(f"unknown schema fields: {sorted(unknown)}")
        columns = []
        for name, kind in (declared.get("columns") or {}).items():
            dtype, shape = (kind["dtype"], tuple(kind.get("shape", ()))) if isinstance(kind, dict) else (kind, ())
            if dtype not in DTYPES:
                raise ValueError(f"unknown dtype {dtype!r} of column {name!r}")
            columns.append(ColumnSignature(name, dtype, shape))
        return cls(tuple(columns), TimeAxis(declared.get("time", "timestamp"), declared.get("time_dtype", "datetime"), declared.get("timezone")))

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(self.time.column, DTYPES[self.time.dtype]), *[T.StructField(c.name, c.spark) for c in self.columns]])


_DURATION = re.compile(r"(\d+)(mo|ns|us|ms|s|m|h|d|w|q|y|i)")
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_MONTHS = {"mo": 1, "q": 3, "y": 12}


@dataclass(frozen=True)
class Tolerance:
    """How old an as-of match may be: microseconds, calendar months, or units of a numeric axis."""

    micros: int = 0
    months: int = 0
    units: float | None = None

    @classmethod
    def parse(cls, value) -> Tolerance | None:
        from datetime import timedelta

        if value is None or isinstance(value, cls):
            return value
        if isinstance(value, timedelta):
            if value < timedelta(0):
                raise ValueError("a tolerance can't be negative")
            return cls(micros=round(value.total_seconds() * 1e6))
        if isinstance(value, bool):
            raise ValueError("a tolerance is a number or a duration")
        if isinstance(value, int | float):
            if value < 0 or not math.isfinite(value):
                raise ValueError("a tolerance can't be negative or infinite")
            return cls(units=value)
        parts = _DURATION.findall(str(value))
        if not parts or "".join(n + u for n, u in parts) != str(value):
            raise ValueError(f"not a duration: {value!r}")
        micros = sum(int(n) * _MICROS[u] for n, u in parts if u in _MICROS) + sum(int(n) // 1000 for n, u in parts if u == "ns")
        months = sum(int(n) * _MONTHS[u] for n, u in parts if u in _MONTHS)
        units = sum(int(n) for n, u in parts if u == "i")
        return cls(micros, months, units or None)
