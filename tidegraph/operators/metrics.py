"""Metrics: a frame reduced to one row, stamped with its last time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.base import Operator, operation
from tidegraph.plans.types import ColumnSignature, FrameSignature


class MetricError(ValueError):
    """A metric that has no value for its input."""


@dataclass(frozen=True)
class Metric(Operator):
    """Non-finite inputs raise, with counts, unless ``drop_nonfinite`` leaves their rows out."""

    drop_nonfinite: bool = False
    timestamp_column: str = "timestamp"

    STRICT = True
    COLUMNS = ()
    MIN_ROWS = 1
    NAME = ""

    def inputs(self):
        return list(self.COLUMNS)

    def accepts(self, name, given):
        return super().accepts(name, given) or (f"{name} must be scalar" if given.shape and given.width != 1 else None)

    def outputs(self, given):
        return FrameSignature((ColumnSignature(self.NAME),))

    def trailing_rows(self):
        return 0

    def prepare(self, df: DataFrame, t: str) -> DataFrame:
        """Columns that the value needs beside the inputs; only good rows are there."""
        return df

    def value(self, t: str) -> Column:
        raise NotImplementedError

    def checks(self, t: str) -> list[tuple[Column, str]]:
        """(aggregate condition that is wrong, what to say)."""
        return []

    def reduce(self, df: DataFrame, t: str) -> DataFrame:
        scalar = [F.get(c, 0).alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in self.COLUMNS]
        df = df.select(t, *scalar)
        odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull()
        bad = None
        for c in self.COLUMNS:
            bad = odd(c) if bad is None else bad | odd(c)
        first = df.agg(F.max(t).alias("stamp"), F.count(F.when(~bad, 1)).alias("good"), *[F.count(F.when(odd(c), 1)).alias(c) for c in self.COLUMNS]).first()
        wrong = {c: first[c] for c in self.COLUMNS if first[c]}
        if wrong and not self.drop_nonfinite:
            raise MetricError(f"{self.NAME}: values that are not finite: {wrong}")
        if first["good"] < self.MIN_ROWS:
            raise MetricError(f"{self.NAME} needs {self.MIN_ROWS} rows, not {first['good']}")
        good = self.prepare(df.filter(~bad), t)
        checks = self.checks(t)
        row = good.agg(self.value(t).alias("value"), *[c.alias(f"w{i}") for i, (c, _) in enumerate(checks)]).first()
        for i, (_, text) in enumerate(checks):
            if row[f"w{i}"]:
                raise MetricError(f"{self.NAME}: {text}")
        value = row["value"]
        if value is None or value != value or value in (float("inf"), float("-inf")):
            raise MetricError(f"{self.NAME} has no finite value")
        schema = df.select(t, F.lit(0.0).alias(self.NAME)).schema
        return df.sparkSession.createDataFrame([(first["stamp"], float(value))], schema)


def _regression(name: str, short: str, error):
    body = {"COLUMNS": ("prediction", "target"), "NAME": short, "value": lambda self, t: F.avg(error(F.col("prediction") - F.col("target"))), "__module__": __name__, "__doc__": f"Mean {short}."}
    return operation("metrics")(dataclass(frozen=True)(type(name, (Metric,), body)))


Mse = _regression("Mse", "mse", lambda e: e * e)
Mae = _regression("Mae", "mae", F.abs)


@operation("metrics")
@dataclass(frozen=True)
class MaxDrawdown(Metric):
    """Largest fall from a running peak above zero, relative to the peak.

    Large frames are cut into chunks of consecutive rows: each chunk starts from the highest value of those before it.
    """

    COLUMNS, NAME, MIN_ROWS = ("equity",), "max_drawdown", 2

    def prepare(self, df, t):
        from tidegraph.operators.ordered import CHUNK_ROWS, in_chunks
        from tidegraph.plans.frames import CHUNK, INDEX

        so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
        if df.count() <= CHUNK_ROWS:
            return df.withColumn("peak", F.max("equity").over(so_far(Window.orderBy(t))))
        rows = in_chunks(df, t, CHUNK_ROWS)
        tops = rows.groupBy(CHUNK).agg(F.max("equity").alias("top"))  # a row for each chunk
        tops = tops.select(CHUNK, F.max("top").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        own = F.max("equity").over(so_far(Window.partitionBy(CHUNK).orderBy(INDEX)))
        return rows.join(tops, CHUNK).withColumn("peak", F.greatest(own, "before"))

    def value(self, t):
        return F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))

    def checks(self, t):
        return [(F.max("peak") <= 0, "equity is never above zero")]


@operation("metrics")
@dataclass(frozen=True)
class Sharpe(Metric):
    """Mean over sample deviation, not annualised."""

    COLUMNS, NAME, MIN_ROWS = ("returns",), "sharpe", 2

    def value(self, t):
        s = F.stddev_samp("returns")
        return F.when(s > 0, F.avg("returns") / s)

    def checks(self, t):
        return [(F.min("returns") == F.max("returns"), "returns are constant"), (F.stddev_samp("returns") == 0, "returns do not vary")]


@operation("metrics")
@dataclass(frozen=True)
class TotalReturn(Metric):
    """Last over first, less 1."""

    COLUMNS, NAME, MIN_ROWS = ("equity",), "total_return", 2

    def value(self, t):
        return F.try_divide(F.max_by("equity", t), F.min_by("equity", t)) - 1

    def checks(self, t):
        return [(F.min_by("equity", t) <= 0, "the first equity is not above zero")]
