"""Live runs of graphs: each micro-batch is computed with the rows that its windows reach back to.

A graph's lookback is the sum of trailing rows along its longest path; a keyed state holds that many rows of each
series, and only results of new rows come out.  Rows must come in order of time within a series; late rows are left
out, as they are by any watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegraph.plans.graph import Graph


def lookback(graph: Graph) -> int | None:
    """Rows before the newest that its result reads; None if all of them."""
    reach: dict[str, int | None] = {}
    for n in graph.nodes:
        own, above = n.op.trailing_rows(), [reach[p.id] for p in n.parents]
        reach[n.id] = None if own is None or None in above else own + max(above, default=0)
    found = [reach[t.id] for t in graph.terminals]
    return None if None in found else max(found)


def rolling_stream(stream: DataFrame, key: str, time: str, compute, rows: int, schema: T.StructType) -> DataFrame:
    """Apply ``compute`` (ordered pandas frame to frame, row by row) to an unbounded, keyed stream.

    ``rows`` earlier rows of each key are kept in Spark's state store, so memory does not grow with the stream.
    """
    columns = stream.columns
    state = T.StructType([T.StructField("body", T.BinaryType())])

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        import io

        new = pd.concat(list(batches), ignore_index=True).sort_values(time, kind="stable")
        if held.exists:
            old = pd.read_parquet(io.BytesIO(held.get[0]))
            new = new[new[time] > old[time].max()]
        else:
            old = new.iloc[:0]
        both = pd.concat([old, new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        kept = io.BytesIO()
        both[columns].tail(max(rows, 1)).to_parquet(kept, index=False)
        held.update((kept.getvalue(),))
        if len(new):
            yield compute(both).iloc[len(both) - len(new) :][schema.names]

    return stream.groupBy(key).applyInPandasWithState(step, schema, state, "append", "NoTimeout")
