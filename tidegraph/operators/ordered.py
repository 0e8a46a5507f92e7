"""Operators over the whole ordered frame: exponentially weighted statistics and block permutation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.base import Operator, operation, positive
from tidegraph.operators.transforms import Unary
from tidegraph.plans.frames import CHUNK, INDEX, numbered, staged
from tidegraph.plans.types import FrameSignature

#: Rows in a chunk of an ordered scan.
CHUNK_ROWS = 250_000


def in_chunks(df: DataFrame, t: str, rows: int) -> DataFrame:
    """``df`` with INDEX and CHUNK, and no task of more than ``rows`` rows to a chunk."""
    out = numbered(df.withColumnRenamed(t, "__t") if t != "__t" else df)
    out = out.withColumnRenamed("__t", t) if t != "__t" else out
    return out.withColumn(CHUNK, F.floor(F.col(INDEX) / F.lit(rows)))


def recurrence(added: np.ndarray, fade: float, start: float) -> np.ndarray:
    """y[i] = fade * y[i - 1] + added[i], from y[-1] = start; rounded as the plain loop rounds, row after row."""
    if fade == 0:
        return added.astype(np.float64)
    fade = float(fade)
    return np.fromiter(accumulate(added.tolist(), lambda y, a: fade * y + a, initial=float(start)), np.float64, len(added) + 1)[1:]


@dataclass(frozen=True)
class Ewm(Unary):
    """Exponentially weighted statistics over all rows so far; weights fall with every row, missing or not.

    The sums of weights and weighted powers are linear recurrences: each chunk is scanned on its own, chunk ends are
    combined in a scan over one row per chunk, and a second scan of the chunks starts from there.  Up to CHUNK_ROWS rows
    are one chunk, scanned once.

    Means of decimals can be exact ties of a later rounding, so the scans keep to the plain loop's order of operations;
    what came before a chunk is far below the last digit at its end, unless alpha is tiny.
    """

    alpha: float = 0.1
    adjust: bool = True
    min_samples: int = 1

    BATCH = True
    #: Are the values' distances from their mean summed up?  Against cancellation; it costs the plain loop's last digit.
    CENTERED = False

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be above 0 and at most 1")
        positive(self.min_samples, "min_samples", 0)

    def accepts(self, name, given):
        return super().accepts(name, given) or (f"{name} must be scalar" if given.shape else None)

    def trailing_rows(self):
        return None

    def finish(self, state: np.ndarray, n: np.ndarray, center: float) -> np.ndarray:
        raise NotImplementedError

    def run(self, df: DataFrame, t: str, kinds: dict, schema: T.StructType) -> DataFrame:
        x, name, decay, alpha, adjust, finish = self.input_column, schema.names[1], 1 - self.alpha, self.alpha, self.adjust, self.finish
        centered = self.CENTERED
        fades = np.array([decay, decay * decay, decay, decay])

        def terms(values: np.ndarray, seen: int, center: float) -> tuple[np.ndarray, np.ndarray]:
            """What each row adds to the sums of w, w^2, w x, w x^2; and the values so far."""
            good = ~np.isnan(values)
            weight = np.where(good, 1.0 if adjust else alpha, 0.0)
            if not adjust and not seen and good.any():
                weight[np.argmax(good)] = 1.0
            v = np.where(good, values - center, 0.0)
            return np.stack([weight, weight * weight, weight * v, weight * v * v], axis=1), seen + np.cumsum(good)

        def result(g: pd.DataFrame, values: np.ndarray, center: float, state: np.ndarray, seen: int) -> pd.DataFrame:
            added, n = terms(values, seen, center)
            sums = np.stack([recurrence(added[:, k], fades[k], state[k]) for k in range(4)], axis=1)
            value = finish(sums, n, center)
            return pd.DataFrame({t: g[t], name: pd.Series(value, index=g.index).astype(object).where(value == value, None)})

        numbers = lambda g: g[x].to_numpy(np.float64, na_value=np.nan)
        rows = df.select(t, x)
        if rows.count() <= CHUNK_ROWS:

            def whole(g: pd.DataFrame) -> pd.DataFrame:
                g = g.sort_values(t, kind="stable")
                values = numbers(g)
                center = float(np.nanmean(values)) if centered and (values == values).any() else 0.0
                return result(g, values, center, np.zeros(4), 0)

            return rows.groupBy(F.lit("all")).applyInPandas(whole, schema)

        own = staged(in_chunks(rows, t, CHUNK_ROWS))
        center = (own.agg(F.avg(F.when(~F.isnan(x), F.col(x)))).first()[0] or 0.0) if centered else 0.0

        # where a chunk's first scan starts: without adjustment the weights go down to their limits, from 1, and stay
        before = np.array([0.0, 0.0, 0.0, 0.0] if adjust else [1.0, 1.0, 0.0, 0.0])

        def ends(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(INDEX, kind="stable")
            values = numbers(g)
            # as if values had come before (weight alpha), and as if none had (weight 1 for the first)
            both = (terms(values, 1, center)[0], before), (terms(values, 0, center)[0], np.zeros(4))
            later, fresh = ([recurrence(added[:, k], fades[k], start[k])[-1] for k in range(4)] for added, start in both)
            return pd.DataFrame([[g[CHUNK].iloc[0], len(g), int((values == values).sum()), *later, *fresh]], columns=["c", "rows", "n", *[f"l{i}" for i in range(4)], *[f"f{i}" for i in range(4)]])

        kinds_of = "c long, rows long, n long, " + ", ".join(f"{k}{i} double" for k in "lf" for i in range(4))

        def carry(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("c")
            state, n, out = np.zeros(4), 0, []
            for r in g.itertuples(index=False):
                out.append((r.c, *state, n))
                state = np.array([r.f0, r.f1, r.f2, r.f3]) if n == 0 else (state - before) * fades**r.rows + np.array([r.l0, r.l1, r.l2, r.l3])
                n += r.n
            return pd.DataFrame(out, columns=["c", "s0", "s1", "s2", "s3", "sn"])

        starts = own.groupBy(CHUNK).applyInPandas(ends, kinds_of).groupBy(F.lit("all")).applyInPandas(carry, "c long, s0 double, s1 double, s2 double, s3 double, sn long")

        def final(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(INDEX, kind="stable")
            r = g.iloc[0]
            return result(g, numbers(g), center, np.array([r.s0, r.s1, r.s2, r.s3]), int(r.sn))

        joined = own.join(starts, own[CHUNK] == starts["c"]).drop("c")
        return joined.groupBy(CHUNK).applyInPandas(final, schema)


@operation("transform")
@dataclass(frozen=True)
class EwmMean(Ewm):
    """Exponentially weighted mean."""

    def finish(self, s, n, center):
        with np.errstate(all="ignore"):
            return np.where((n >= max(1, self.min_samples)) & (s[:, 0] > 0), s[:, 2] / s[:, 0] + center, np.nan)


@operation("transform")
@dataclass(frozen=True)
class EwmStd(Ewm):
    """Exponentially weighted, debiased standard deviation; at least two values."""

    CENTERED = True

    def finish(self, s, n, center):
        with np.errstate(all="ignore"):
            w, w2, wx, wxx = s.T
            var = np.maximum(wxx / w - (wx / w) ** 2, 0) * w * w / (w * w - w2)
            return np.where((n >= max(2, self.min_samples)) & (w * w > w2), np.sqrt(var), np.nan)


_MASK = (1 << 64) - 1


def split_mix(seed: int):
    """SplitMix64: the published generator of 64-bit numbers."""
    state = seed & _MASK
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def permuted_blocks(n: int, seed: int) -> list[int]:
    """Fisher-Yates from the end: at each place, a draw modulo the places left."""
    order, draws = list(range(n)), split_mix(seed)
    for place in range(n - 1, 0, -1):
        other = next(draws) % (place + 1)
        order[place], order[other] = order[other], order[place]
    return order


@operation("perturb")
@dataclass(frozen=True)
class BlockPermute(Operator):
    """All bound columns dealt anew in blocks of rows; the times stay.

    Only the order of the blocks is made on the driver, and sent out as a small table; rows move by one join on
    their positions.
    """

    input_columns: tuple[str, ...] = ("value",)
    block_length: int = 1
    seed: int = 0
    timestamp_column: str = "timestamp"

    BATCH = STRICT = MOVES_ROWS = True

    def __post_init__(self):
        object.__setattr__(self, "input_columns", tuple(self.input_columns))
        positive(self.block_length, "block_length")
        positive(self.seed, "seed", 0)

    def inputs(self):
        return list(self.input_columns)

    def accepts(self, name, given):
        return None

    def outputs(self, given):
        return FrameSignature(tuple(given[c].named(c) for c in self.input_columns))

    def trailing_rows(self):
        return None

    def run(self, df: DataFrame, t: str, kinds: dict, schema: T.StructType) -> DataFrame:
        rows = staged(numbered(df.withColumnRenamed(t, "__t") if t != "__t" else df))
        n = rows.count()
        if n < 2 or not self.input_columns:
            return df.select(*schema.names)
        size = self.block_length
        blocks = math.ceil(n / size)
        order = permuted_blocks(blocks, self.seed)
        lengths = np.minimum(size, n - np.array(order) * size)
        starts = np.cumsum(lengths) - lengths
        table = df.sparkSession.createDataFrame(pd.DataFrame({"b": order, "s": starts}))
        payload = rows.withColumn("b", F.floor(F.col(INDEX) / F.lit(size))).join(table, "b")
        payload = payload.select((F.col("s") + F.col(INDEX) % size).alias(INDEX), *[n for n in schema.names if n != t])
        return rows.select(INDEX, F.col("__t").alias(t)).join(payload, INDEX).select(*schema.names)
