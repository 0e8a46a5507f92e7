"""Small frames as nodes, and results as lists."""

from datetime import datetime, timedelta

import pandas as pd

from tidegraph import api as A
from tidegraph.plans.graph import Executor

START = datetime(2026, 1, 1)


def minute(k):
    return START + timedelta(minutes=k)


def series(values, at=None, name="value"):
    """A source node of one value a minute."""
    at = range(len(values)) if at is None else at
    frame = pd.DataFrame({"timestamp": pd.Series([minute(k) for k in at]).astype("datetime64[us]"), name: pd.array(values, dtype="Float64")})
    return A.Node(A.DataFrameSource, config=A.DataFrameSource.of(frame, {"columns": {name: "float64"}}))


def arrays(rows, width, name="value"):
    import pyarrow as pa

    table = pa.table({"timestamp": pa.array([minute(k) for k in range(len(rows))], pa.timestamp("us")), name: pa.array(rows, pa.list_(pa.float64()))})
    return A.Node(A.DataFrameSource, config=A.DataFrameSource.of(table, {"columns": {name: {"dtype": "float64", "shape": [width]}}}))


def column(spark, output, **options):
    """An output's values in order of time."""
    df = Executor(spark, **options).table({"out": output}).orderBy(output.node.signature.time.column)
    return [r["out"] for r in df.collect()]


def apply(op, node, name="value", **params):
    source = node if isinstance(node, A.Output) else node.output(name)
    return A.Node(op, {name: source}, {"input_column": name, "output_column": "out", **params}).out
