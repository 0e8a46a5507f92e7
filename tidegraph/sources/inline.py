"""Frames given in the program, and tables fetched from web services."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators.base import operation
from tidegraph.plans.frames import within
from tidegraph.plans.types import FrameSignature, Tolerance
from tidegraph.sources.files import SourceError, _Source, coerce


def arrow_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


@operation("source")
@dataclass(frozen=True)
class DataFrameSource(_Source):
    """A pandas frame or Arrow table held as Arrow bytes, which are its identity.  For small tables."""

    body: bytes
    schema: dict | None = None
    output_signature: FrameSignature | None = None

    @classmethod
    def of(cls, frame, schema: dict | FrameSignature) -> DataFrameSource:
        table = frame if isinstance(frame, pa.Table) else pa.Table.from_pandas(frame, preserve_index=False)
        kind = {"output_signature": schema} if isinstance(schema, FrameSignature) else {"schema": schema}
        return cls(arrow_bytes(table), **kind)

    def read(self, spark):
        table = pa.ipc.open_stream(self.body).read_all()
        table = table.append_column("__seq", pa.array(range(table.num_rows), pa.int64()))
        return coerce(spark.createDataFrame(table), self.signature()), "__seq"


def fetch_json(url: str, timeout: float = 30) -> object:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


def parse_history(payload: object) -> pd.DataFrame:
    """(timestamp, price) of ``{"history": [{"t": unix seconds, "p": price}]}``, in order of time."""
    if not isinstance(payload, dict) or not isinstance(payload.get("history"), list):
        raise SourceError("not a price history")
    rows = [(datetime.fromtimestamp(float(x["t"]), UTC).replace(tzinfo=None), float(x["p"])) for x in payload["history"]]
    frame = pd.DataFrame(rows, columns=["timestamp", "price"])
    return frame.astype({"timestamp": "datetime64[us]", "price": "float64"}).sort_values("timestamp", kind="stable").reset_index(drop=True)


def align_outcomes(spark: SparkSession, outcomes: list[pd.DataFrame], tolerance=None) -> DataFrame:
    """(timestamp, price array): each outcome's last price at or before every time of any outcome."""
    limit = Tolerance.parse(tolerance)
    parts = [spark.createDataFrame(o).select("timestamp", F.struct(F.col("timestamp").alias("t"), "price").alias(f"p{i}")) for i, o in enumerate(outcomes)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("timestamp").agg(*[F.last(f"p{i}", ignorenulls=True).alias(f"p{i}") for i in range(len(parts))])
    w = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    carried = union.select("timestamp", *[F.last(f"p{i}", ignorenulls=True).over(w).alias(f"p{i}") for i in range(len(parts))])
    price = lambda i: F.col(f"p{i}.price") if limit is None else F.when(within(F.col("timestamp"), F.col(f"p{i}.t"), limit), F.col(f"p{i}.price"))
    return carried.select("timestamp", F.array(*[price(i) for i in range(len(parts))]).alias("price"))


@operation("source")
@dataclass(frozen=True)
class PriceHistory(_Source):
    """Prices of one market, or of each outcome of an event as an array, from a JSON service.

    ``urls`` are fetched on the driver; ``fetch`` replaces the fetching, for tests and for other transports.
    """

    urls: tuple[str, ...]
    tolerance: str | None = None
    fetch: Callable = fetch_json
    schema: dict | None = None
    output_signature: FrameSignature | None = None

    EXCLUDED = ("fetch",)

    def __post_init__(self):
        object.__setattr__(self, "urls", tuple(self.urls))

    def signature(self):
        from tidegraph.plans.types import ColumnSignature

        n = len(self.urls)
        return FrameSignature((ColumnSignature("price", "float64", (n,) if n > 1 else ()),))

    def read(self, spark):
        frames = [parse_history(self.fetch(u)) for u in self.urls]
        if len(frames) == 1:
            return spark.createDataFrame(frames[0].assign(__seq=range(len(frames[0])))), "__seq"
        return align_outcomes(spark, frames, self.tolerance), None


@operation("source")
@dataclass(frozen=True)
class OhlcvSource(_Source):
    """(timestamp, open, high, low, close, volume) from any function that gives a pandas frame of them; lenient casts, sorted."""

    symbol: str
    fetch: Callable
    start: str | None = None
    end: str | None = None
    interval: str = "1d"
    schema: dict | None = None
    output_signature: FrameSignature | None = None

    EXCLUDED = ("fetch",)

    def signature(self):
        return FrameSignature((("open",), ("high",), ("low",), ("close",), ("volume", "int64")))

    def read(self, spark):
        frame = self.fetch(self.symbol, self.start, self.end, self.interval)
        frame = frame.reset_index().rename(columns=lambda c: str(c).lower().replace(" ", "_")).rename(columns={"date": "timestamp", "datetime": "timestamp", "index": "timestamp"})
        out = pd.DataFrame({"timestamp": pd.to_datetime(frame["timestamp"], utc=True).dt.tz_localize(None).astype("datetime64[us]")})
        for c in ("open", "high", "low", "close"):
            out[c] = pd.to_numeric(frame[c], errors="coerce").astype("float64")
        out["volume"] = pd.to_numeric(frame["volume"], errors="coerce").astype("Int64")
        out = out.sort_values("timestamp", kind="stable").reset_index(drop=True)
        table = pa.Table.from_pandas(out, preserve_index=False).append_column("__seq", pa.array(range(len(out)), pa.int64()))
        return spark.createDataFrame(table), "__seq"


def digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()
