import json

import pandas as pd
import pytest
from support import apply, arrays, column, minute, series

from tidegraph import api as A
from tidegraph.plans.graph import Executor, Graph, GraphError
from tidegraph.plans.node import Node


def pair(spark, left, right, **options):
    packed = Node(A.FeaturePacker, {"left": left.value, "right": right.value}, {"input_columns": ("left", "right")}, **options).features
    df = Executor(spark).table({"out": packed}).orderBy("timestamp")
    return [(r["timestamp"], *r["out"]) for r in df.collect()]


def test_alignment_on_the_union_of_times(spark):
    got = pair(spark, series([10, 20], [0, 2]), series([100, 300], [1, 3]))
    assert got == [(minute(0), 10, None), (minute(1), 10, 100), (minute(2), 20, 100), (minute(3), 20, 300)]


def test_alignment_with_tolerance(spark):
    got = pair(spark, series([10], [0]), series([200, 300], [2, 3]), tolerances={"left": "1m"})
    assert got == [(minute(0), 10, None), (minute(2), None, 200), (minute(3), None, 300)]


def test_one_parent_with_two_tolerances(spark):
    source, anchor = series([10], [0]), series([200], [2])
    node = Node(A.FeaturePacker, {"a": source.value, "b": source.value, "c": anchor.value}, {"input_columns": ("a", "b", "c")}, tolerances={"a": "1m"}).features
    assert column(spark, node) == [[10, 10, None], [None, 10, 200]]


def test_nulls_in_matched_rows_stay(spark):
    got = pair(spark, series([10, None], [0, 2]), series([1, 2, 3], [1, 2, 3]))
    assert [g[1] for g in got] == [10, 10, None, None]


def test_repeated_times_keep_the_last_row(spark):
    assert column(spark, apply(A.Negate, series([1, 2, 3], [0, 0, 1]))) == [-2, -3]


def test_repeated_times_may_all_be_kept(spark, tmp_path):
    """Windows, dropped nulls, whole-frame steps and chunks see every row, those of one time in source order."""
    values, at = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0], [0, 0, 0, 1, 1, 2]
    pd.DataFrame({"timestamp": pd.Series([minute(k) for k in at]).astype("datetime64[us]"), "value": values}).to_parquet(tmp_path / "x.parquet")
    node = lambda repeats: Node(A.DatasetSource, parameters={"path": str(tmp_path / "x.parquet"), "schema": {"time": "timestamp", "columns": {"value": "float64"}}, "repeats": repeats})
    every = node("all")
    step = apply(A.Delta, every)
    for options in ({}, {"chunking": A.Chunking(above=2, rows=2)}):
        rows = sorted(tuple(r) for r in Executor(spark, **options).table({"value": every.value, "step": step, "gap": every.output("delta_t")}).collect())
        assert sorted((v, s) for _, v, s, _ in rows if s is not None) == [(2.0, -2.0), (4.0, 3.0), (5.0, -3.0), (7.0, 2.0), (8.0, 6.0)]
        assert sorted(g for *_, g in rows if g is not None) == [0, 0, 0, 60_000_000, 60_000_000]
        # the steps' row without a value goes, and they meet the values again row by row
        kept = Node(A.FeaturePacker, {"step": step}, {"input_columns": ("step",)}, null_policies={"step": "drop"}).features
        both = Node(A.FeaturePacker, {"value": every.value, "kept": kept}, {"input_columns": ("value", "kept")}, null_policies={"kept": "drop"}).features
        assert sorted(column(spark, both, **options)) == [[2.0, -2.0], [4.0, 3.0], [5.0, -3.0], [7.0, 2.0], [8.0, 6.0]]
        mean = Executor(spark, **options).table({"value": every.value, "out": apply(A.EwmMean, every, alpha=0.5, adjust=False)})
        assert sorted((r["value"], r["out"]) for r in mean.collect()) == [(1.0, 1.0), (2.0, 2.25), (4.0, 2.5), (5.0, 5.0625), (7.0, 6.03125), (8.0, 5.125)]
    assert column(spark, node("last").value) == [2.0, 5.0, 7.0]
    # beside another source the last row of a time counts
    other = series([10.0, 20.0, 30.0])
    assert column(spark, Node(A.Spread, {"left": other.value, "right": every.value}).value) == [8.0, 15.0, 23.0]
    total = Node(A.TotalReturn, {"equity": every.value})
    assert [tuple(r) for r in Executor(spark).table({"r": total.output("total_return")}).collect()] == [(minute(2), 6.0)]
    with pytest.raises(Exception, match="repeats"):
        node("first")


def test_one_timeline_needs_no_join(spark):
    base = series([1, 2, 3, 4])
    a, b = apply(A.Delta, base), apply(A.RollingMean, base)
    both = Node(A.Spread, {"left": a, "right": b}).value
    plan = Executor(spark).table({"out": both})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1


def test_chunks_give_the_same_rows(spark):
    r = [float((i * 7919) % 101) for i in range(500)]
    chunked = {"chunking": A.Chunking(above=50, rows=40)}
    node = series(r)
    for op, params in ((A.RollingMean, {"periods": 9}), (A.Lag, {"periods": 5}), (A.Lead, {"periods": 7}), (A.RollingMedian, {"periods": 20})):
        assert column(spark, apply(op, node, **params)) == pytest.approx(column(spark, apply(op, node, **params), **chunked), nan_ok=True)
    other = series([float(i) for i in range(90)], [i * 5 + 2 for i in range(90)])
    both = Node(A.Spread, {"left": node.value, "right": other.value}).value
    assert column(spark, both) == column(spark, both, **chunked)


def test_null_policies(spark):
    base = series([1, None, 3, 4])
    roll = lambda **k: Node(A.RollingMean, {"value": base.value}, {"periods": 3, "min_samples": 2, "output_column": "out"}, **k).out
    assert column(spark, roll(null_policies={"value": "drop"})) == [None, 2, pytest.approx(8 / 3)]
    assert column(spark, roll(null_policies={"value": "fill"}, null_fill_values={"value": 0.0})) == [None, 0.5, pytest.approx(4 / 3), pytest.approx(7 / 3)]
    with pytest.raises(A.ExecutionError, match="value has 1"):
        column(spark, roll(null_policies={"value": "error"}))
    handled = roll(null_handlers={"value": forward}, null_handler_versions={"value": "1"})
    assert column(spark, handled) == [None, 1, pytest.approx(5 / 3), pytest.approx(8 / 3)]
    wide = arrays([[1.0, None], [2.0, 3.0]], 2)
    assert column(spark, Node(A.Negate, {"value": wide.value}, {"output_column": "out"}, null_policies={"value": "drop"}).out) == [[-2, -3]]


def forward(s):
    return s.ffill()


def test_delta_t(spark):
    assert column(spark, series([1, 2, 3], [0, 1, 4]).output("delta_t")) == [None, 60_000_000, 180_000_000]


def test_identity():
    a, b = series([1, 2]), series([1, 2])
    assert a.id == b.id and series([1, 3]).id != a.id
    one = Node(A.Delta, {"value": a.value}, name="x")
    assert one.id == Node(A.Delta, {"value": b.value}, name="y", materialize=True).id
    assert len({one.id, Node(A.Delta, {"value": a.value}, {"periods": 2}).id, Node(A.Delta, {"value": a.value}, tolerances={"value": "5m"}).id, Node(A.Delta, {"value": a.value}, null_policies={"value": "drop"}).id}) == 4
    with pytest.raises(AttributeError):
        one.name = "z"


def codes(*nodes):
    return {i.code for i in Graph.validate(list(nodes))}


def test_validation_reports_everything():
    base = series([1, 2])
    assert codes(Node(A.Delta, {})) == {"NON_EMPTY_INPUT_WITHOUT_BINDINGS"}
    assert codes(Node(A.Spread, {"left": base.value})) == {"MISSING_BINDING"}
    assert codes(Node(A.Delta, {"value": base.value, "more": base.value})) == {"UNEXPECTED_BINDING"}
    assert codes(Node(A.Delta, {"value": base.value}, tolerances={"x": 1})) == {"UNEXPECTED_TOLERANCE"}
    assert codes(Node(A.Delta, {"value": base.value}, null_policies={"x": "drop"})) == {"UNEXPECTED_NULL_HANDLER"}
    assert codes(Node(A.Delta, {"value": base.value}, null_policies={"value": "fill"})) == {"MISSING_NULL_FILL_VALUE"}
    assert codes(Node(A.Delta, {"value": base.value}, null_fill_values={"value": 1})) == {"UNEXPECTED_NULL_FILL_VALUE"}
    assert codes(Node(A.FeatureUnpacker, {"features": base.value})) == {"INPUT_TYPE_MISMATCH"}
    middle = Node(A.Log, {"value": base.value})
    assert codes(Node(A.Delta, {"value": middle.value}), middle) == {"PARENT_OUTSIDE_GRAPH"}
    with pytest.raises(GraphError):
        Graph(Node(A.Delta, {}))
    with pytest.raises(AttributeError):
        _ = base.nothing


def test_lookahead_only_into_targets():
    base = series([1.0, 2.0])
    ahead = Node(A.Lead, {"value": base.value}).value
    pack = lambda x, n: Node(A.FeaturePacker, {"x": x}, {"input_columns": ("x",), "output_column": n}).output(n)
    good = Node(A.LinearRegression, {"features": pack(base.value, "f"), "target": pack(ahead, "t")})
    bad = Node(A.LinearRegression, {"features": pack(ahead, "f"), "target": pack(base.value, "t")})
    assert Graph.validate(good) == [] and {i.code for i in Graph.validate(bad)} == {"LOOKAHEAD_INTO_FEATURES"}


def test_future_rows_change_nothing_before(spark):
    values = [float(i * i % 17) for i in range(40)]
    changed = values[:30] + [99.0] * 10
    for op, params in ((A.RollingMean, {}), (A.EwmMean, {}), (A.Delta, {}), (A.RollingPercentileRank, {})):
        assert column(spark, apply(op, series(values), **params))[:30] == pytest.approx(column(spark, apply(op, series(changed), **params))[:30], nan_ok=True)


def test_execute_and_describe(spark):
    base = series([0.25, 0.5, 0.75])
    change = Node(A.Delta, {"value": apply(A.Logit, base)}, {"output_column": "change"})
    seen = []
    df = Graph(change).execute(spark, on_progress=lambda n, k, total: seen.append((k, total)))
    assert df.columns == ["timestamp", "change"] and [r["change"] for r in df.collect()] == [None, pytest.approx(1.098612288668), pytest.approx(1.098612288668)]
    assert seen == [(1, 3), (2, 3), (3, 3)]
    assert json.dumps(Graph(change).describe())
    two = Graph([change, Node(A.Abs, {"value": base.value})], check=False)
    assert len(two.terminals) == 2


def test_cache(spark, tmp_path):
    base = series([1, 2, 4])
    node = Node(A.Delta, {"value": base.value}, materialize=True)
    executor = Executor(spark, cache_dir=str(tmp_path))
    first = [r["value"] for r in Graph(node).execute(executor=executor).collect()]
    manifest = next(tmp_path.glob("*/*/*/*/manifest.json"))
    data = json.loads(manifest.read_text())
    assert data["node_id"] == node.id and data["success"] and data["row_count"] == 3
    seen = []
    again = Graph(node).execute(executor=executor, on_progress=lambda n, k, t: seen.append(n.op.OP))
    assert [r["value"] for r in again.collect()] == first and seen == ["transform.delta"]
    manifest.write_text("{broken")
    assert [r["value"] for r in Graph(node).execute(executor=executor).collect()] == first


def test_errors_name_the_node(spark):
    node = Node(A.CSVSource, parameters={"path": "/nowhere.csv", "content_sha256": "0" * 64, "schema": {"columns": {"x": "float64"}}}, name="prices")
    with pytest.raises(A.ExecutionError, match="Execution failed at node 'prices' \\(source.csv_source@0.2.0\\)"):
        Graph(node).execute(spark)


def test_tolerances_parse():
    assert A.Tolerance.parse("1h30m").micros == 5_400_000_000 and A.Tolerance.parse("1mo").months == 1 and A.Tolerance.parse(3).units == 3
    for bad in ("5x", -1, True, "m"):
        with pytest.raises(ValueError):
            A.Tolerance.parse(bad)
