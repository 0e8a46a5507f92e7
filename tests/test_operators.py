import math

import numpy as np
import pytest
from support import apply, arrays, column, minute, series

from tidegraph import api as A
from tidegraph.plans.graph import Executor

NAN, INF = float("nan"), float("inf")


def same(got, want):
    assert len(got) == len(want), got
    for a, b in zip(got, want, strict=True):
        if b is None:
            assert a is None, got
        elif isinstance(b, list):
            same(a, b)
        else:
            assert a is not None and (a == pytest.approx(b, rel=1e-6, abs=1e-9) or (a != a and b != b)), got


GOLDEN = [
    (A.RollingMean, [1, 2, 4, 8, None, 32], {"periods": 3, "min_samples": 3}, [None, None, 7 / 3, 14 / 3, None, None]),
    (A.RollingSum, [1, 2, 3, 4, 5], {}, [1, 3, 6, 9, 12]),
    (A.RollingMax, [1, 2, 3, 4, 5], {}, [1, 2, 3, 4, 5]),
    (A.RollingMin, [1, 2, 3, 4, 5], {}, [1, 1, 1, 2, 3]),
    (A.RollingMedian, [1, 2, 3, 4, 5], {}, [1, 1.5, 2, 3, 4]),
    (A.RollingQuantile, [1, None, 3, 4], {"periods": 3, "min_samples": 1}, [1, 1, 2, 3.5]),
    (A.RollingQuantile, [1, None, 3, 4], {"periods": 3, "min_samples": 2}, [None, None, 2, 3.5]),
    (A.RollingPercentileRank, [-4, 3, -2, None, 5, -1], {"periods": 3}, [0, 1, 0.5, None, 1, 0]),
    (A.RollingPercentileRank, [2, 2, 1], {"method": "average"}, [0, 0.5, 0]),
    (A.RollingPercentileRank, [2, 2, 1], {"method": "max"}, [0, 1, 0]),
    (A.RollingVar, [1, 2, 3, 4, 5], {"min_samples": 3}, [None, None, 1, 1, 1]),
    (A.RollingVar, [1, 2, 3, 4, 5], {"min_samples": 3, "ddof": 0}, [None, None, 2 / 3, 2 / 3, 2 / 3]),
    (A.RollingStd, [1, 3, 5], {}, [None, math.sqrt(2), 2]),
    (A.RollingZScore, [1, 1, 1, 4], {}, [None, None, None, 2 / math.sqrt(3)]),
    (A.PctChange, [1, 2, 4, 0, 8], {}, [None, 1, 1, -1, None]),
    (A.PctChange, [1, 2, 4, 8], {"periods": 2}, [None, None, 3, 3]),
    (A.LogReturn, [1, 2, 4, 0, -1, None], {}, [None, math.log(2), math.log(2), None, None, None]),
    (A.Log, [0, 1, None, 2], {}, [None, 0, None, math.log(2)]),
    (A.Exp, [0, 1, None, 2], {}, [1, math.e, None, math.e**2]),
    (A.Logit, [0, 0.5, 0.75, 1], {}, [None, 0, math.log(3), None]),
    (A.Abs, [-1, None, 2], {}, [1, None, 2]),
    (A.Sign, [-3, 0, 3], {}, [-1, 0, 1]),
    (A.Sqrt, [-1, 4, None], {}, [None, 2, None]),
    (A.Power, [2, -3, 0], {"exponent": -1.0}, [0.5, -1 / 3, None]),
    (A.Clip, [-5, 0.5, 5, None], {"lower": 0.0, "upper": 1.0}, [0, 0.5, 1, None]),
    (A.Negate, [1, None], {}, [-1, None]),
    (A.Lag, [1, 2, 3], {"periods": 2}, [None, None, 1]),
    (A.Lead, [1, 2, 3], {}, [2, 3, None]),
    (A.Delta, [1, 4, 9], {}, [None, 3, 5]),
]


@pytest.mark.parametrize("op,values,params,want", GOLDEN, ids=lambda x: getattr(x, "__name__", ""))
def test_golden(spark, op, values, params, want):
    same(column(spark, apply(op, series(values), **params)), want)


def test_nan_stays_nan(spark):
    nan = series([1.0, 0.0])
    zero = A.Node(A.Ratio, {"left": nan.value, "right": A.Node(A.Clip, {"value": nan.value}, {"upper": 0.0}).value}).value
    assert [x if x is None else x != x for x in column(spark, zero)] == [None, True]
    same(column(spark, apply(A.Clip, zero, lower=0.0, upper=1.0)), [None, NAN])


def test_pairs(spark):
    left, right = series([0.5, 2, 0, -1, None, 4], name="left"), series([0.5, 0.5, 1, 1, 1, None], name="right")
    same(column(spark, A.Node(A.LogRatio, {"left": left.left, "right": right.right}).value), [0, math.log(4), None, None, None, None])
    same(column(spark, A.Node(A.Spread, {"left": left.left, "right": right.right}).value), [0, 1.5, -1, -2, None, None])
    x, y = series([1, 2, 3, 4, 5], name="left"), series([2, 4, 6, 8, 10], name="right")
    same(column(spark, A.Node(A.RollingCov, {"left": x.left, "right": y.right}, {"min_samples": 3}).value), [None, None, 2, 2, 2])
    m = A.Node(A.RollingCovMatrix, {"left": x.left, "right": y.right}, {"input_columns": ("left", "right"), "min_samples": 3}).value
    same(column(spark, m), [[None] * 4, [None] * 4, [1, 2, 2, 4], [1, 2, 2, 4], [1, 2, 2, 4]])


def test_arrays(spark):
    node = arrays([[1.0, -2.0], [3.0, None], [None, 5.0]], 2)
    same(column(spark, apply(A.Abs, node)), [[1, 2], [3, None], [None, 5]])
    same(column(spark, apply(A.Delta, node)), [[None, None], [2, None], [None, None]])
    same(column(spark, apply(A.Lag, node)), [[None, None], [1, -2], [3, None]])
    assert column(spark, apply(A.Lead, node))[-1] is None
    packed = A.Node(A.FeaturePacker, {"value": node.value, "x": series([7, None, 9], name="x").x}, {"input_columns": ("value", "x")}).features
    same(column(spark, packed), [[1, -2, 7], [3, None, None], [None, 5, 9]])
    assert packed.node.signature["features"].width == 3
    flat = A.Node(A.FeatureUnpacker, {"features": packed})
    same(column(spark, flat.feature_2), [7, None, 9])
    same(column(spark, A.Node(A.LogRatio, {"left": node.value, "right": apply(A.Abs, node)}).value), [[0, None], [0, None], [None, 0]])


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm(spark, adjust, monkeypatch):
    from tidegraph.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 7)
    r = np.random.default_rng(0)
    values = [None if r.random() < 0.2 else float(x) for x in r.normal(5, 2, 40)]
    mean, std, a = [], [], 0.3
    for t in range(len(values)):
        seen = [i for i in range(t + 1) if values[i] is not None]
        if not seen:
            mean.append(None), std.append(None)
            continue
        w = np.array([(1 - a) ** (t - i) * (1.0 if adjust or i == seen[0] else a) for i in seen])
        x = np.array([values[i] for i in seen])
        m = (w @ x) / w.sum()
        mean.append(m)
        std.append(math.sqrt((w @ (x - m) ** 2) / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())) if len(seen) > 1 else None)
    same(column(spark, apply(A.EwmMean, series(values), alpha=a, adjust=adjust)), mean)
    same(column(spark, apply(A.EwmStd, series(values), alpha=a, adjust=adjust)), std)


def test_block_permute(spark):
    from tidegraph.operators.ordered import permuted_blocks, split_mix

    assert next(split_mix(0)) == 0xE220A8397B1DCDAF  # the published generator's first number
    values = list(range(10))
    got = column(spark, A.Node(A.BlockPermute, {"value": series(values).value}, {"block_length": 3, "seed": 5}).value)
    blocks = [values[i : i + 3] for i in range(0, 10, 3)]
    assert got == [x for b in permuted_blocks(4, 5) for x in blocks[b]]
    assert sorted(got) == values and column(spark, A.Node(A.BlockPermute, {"value": series([1]).value}).value) == [1]


def metric(spark, op, params=None, **inputs):
    node = A.Node(op, {k: v.output(k) for k, v in inputs.items()}, params or {})
    return column(spark, node.output(op.NAME))[0]


def test_metrics(spark):
    p, t = series([1, 2, 3], name="prediction"), series([1, 4, 0], name="target")
    assert metric(spark, A.Mse, prediction=p, target=t) == pytest.approx(13 / 3)
    assert metric(spark, A.Mae, prediction=p, target=t) == pytest.approx(5 / 3)
    assert metric(spark, A.MaxDrawdown, equity=series([1, 4, 2, 3], name="equity")) == pytest.approx(0.5)
    assert metric(spark, A.Sharpe, returns=series([1, 2, 3], name="returns")) == pytest.approx(2)
    assert metric(spark, A.TotalReturn, equity=series([2, 9, 3], name="equity")) == pytest.approx(0.5)
    stamp = Executor(spark).table({"x": A.Node(A.Sharpe, {"returns": series([1, 2, 3], name="returns").returns}).sharpe}).first()["timestamp"]
    assert stamp == minute(2)
    for op, name, values in ((A.Sharpe, "returns", [1, 1]), (A.MaxDrawdown, "equity", [-1, -2]), (A.TotalReturn, "equity", [0, 1]), (A.Sharpe, "returns", [1])):
        with pytest.raises(A.ExecutionError):
            metric(spark, op, **{name: series(values, name=name)})


def test_drawdown_in_chunks(spark, monkeypatch):
    from tidegraph.operators import ordered

    values = [float((i * 37) % 101 + 1) for i in range(60)]
    whole = metric(spark, A.MaxDrawdown, equity=series(values, name="equity"))
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 7)
    assert metric(spark, A.MaxDrawdown, equity=series(values, name="equity")) == pytest.approx(whole)


def test_metrics_and_missing_values(spark):
    holes = series([1, None, 3], name="returns")
    with pytest.raises(A.ExecutionError, match="missing values"):
        metric(spark, A.Sharpe, returns=holes)
    node = A.Node(A.Sharpe, {"returns": holes.returns}, {"drop_nonfinite": True}, null_policies={"returns": "pass"})
    assert column(spark, node.sharpe)[0] == pytest.approx(2 / math.sqrt(2))


def test_parameters_are_checked():
    for op, bad in ((A.RollingMean, {"periods": 0}), (A.RollingMean, {"periods": 2, "min_samples": 3}), (A.RollingVar, {"ddof": 3}), (A.Clip, {}), (A.Clip, {"lower": 2.0, "upper": 1.0}), (A.Power, {"exponent": INF}), (A.EwmMean, {"alpha": 0.0}), (A.RollingQuantile, {"quantile": 2.0}), (A.RollingMean, {"window": 20})):
        with pytest.raises(ValueError):
            op.build(bad)


def brute_ewm(values, alpha, adjust, least, std):
    """Weighted sums written out for each row."""
    out = []
    for i in range(len(values)):
        known = [k for k in range(i + 1) if values[k] is not None]
        weights = [(1 - alpha) ** (i - k) * (1.0 if adjust or k == known[0] else alpha) for k in known]
        w, w2 = sum(weights), sum(v * v for v in weights)
        if len(known) < max(2 if std else 1, least) or not w or (std and w * w <= w2):
            out.append(None)
            continue
        mean = sum(v * values[k] for v, k in zip(weights, known, strict=True)) / w
        var = sum(v * (values[k] - mean) ** 2 for v, k in zip(weights, known, strict=True)) / w
        out.append(math.sqrt(var * w * w / (w * w - w2)) if std else mean)
    return out


@pytest.mark.parametrize("rows", [1000, 17])
def test_ewm_against_weights(spark, rows, monkeypatch):
    from tidegraph.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows)
    r = np.random.default_rng(4)
    values = [None if r.random() < 0.2 else float(v) for v in 100 + r.normal(size=60)]
    for alpha, adjust, least in ((0.1, True, 1), (0.3, False, 3), (0.95, False, 1), (1.0, True, 1)):
        for op in (A.EwmMean, A.EwmStd):
            if alpha == 1.0 and op is A.EwmStd:
                continue
            got = column(spark, apply(op, series(values), alpha=alpha, adjust=adjust, min_samples=least))
            same(got, brute_ewm(values, alpha, adjust, least, op is A.EwmStd))


@pytest.mark.parametrize("rows", [10_000, 500])
def test_ewm_mean_rounds_as_the_loop(spark, rows, monkeypatch):
    """To the last bit: means of values in cents can be exact ties of the queries' sixth digit."""
    from tidegraph.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows)
    values = [int(v) / 100 for v in np.random.default_rng(6).integers(0, 50_000, 2000)]
    plain, adjusted, m, w, wx = [], [], None, 0.0, 0.0
    for v in values:
        m = v if m is None else m * 0.75 + 0.25 * v
        w, wx = w * 0.9 + 1, wx * 0.9 + v
        plain.append(m), adjusted.append(wx / w)
    assert column(spark, apply(A.EwmMean, series(values), alpha=0.25, adjust=False)) == plain
    assert column(spark, apply(A.EwmMean, series(values), alpha=0.1)) == adjusted


def test_recurrence_is_the_loop():
    from tidegraph.operators.ordered import recurrence

    r = np.random.default_rng(2)
    for fade in (0.0, 0.01, 0.5, 0.9, 0.9999, 1.0):
        for n in (0, 1, 7, 5000):
            added, y, want = r.normal(size=n), 3.0, []
            for v in added.tolist():
                y = fade * y + v
                want.append(y)
            assert recurrence(added, fade, 3.0 if fade else 0.0) == pytest.approx(want if fade else added.tolist(), rel=1e-9, abs=1e-9)


def test_windows_longer_than_a_chunk(spark):
    values = [float(i % 13) for i in range(60)]
    node = apply(A.RollingMean, series(values), periods=25)
    assert column(spark, node, chunking=A.Chunking(above=10, rows=7)) == pytest.approx(column(spark, node), nan_ok=True)


def test_permuted_delta_t_goes_on_to_single_parents_only(spark):
    x = series([float(i) for i in range(12)], at=[0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66])
    moved = A.Node(A.BlockPermute, {"value": x.value}, {"block_length": 2, "seed": 5})
    gaps = {None if i is None else float(i): g for i, g in zip(range(12), column(spark, x.output("delta_t")), strict=True)}
    chained = apply(A.Abs, apply(A.Negate, moved))
    for node in (moved, chained.node):
        df = Executor(spark).table({"gap": node.output("delta_t"), "v": node.output("value" if node is moved else "out")}).orderBy("timestamp").collect()
        assert [r["gap"] for r in df] == [gaps[r["v"]] for r in df]
    again = A.Node(A.BlockPermute, {"value": moved.value}, {"block_length": 3, "seed": 1})
    twice = Executor(spark).table({"gap": again.output("delta_t"), "v": again.value}).collect()
    assert [r["gap"] for r in twice] == [gaps[r["v"]] for r in twice]
    other = series([1.0, 2.0], at=[2, 70], name="o")
    both = A.Node(A.Spread, {"left": moved.value, "right": other.o}, {"left_column": "left", "right_column": "right", "output_column": "out"})
    anew = [r["gap"] for r in Executor(spark).table({"gap": both.output("delta_t"), "v": both.out}).orderBy("timestamp").collect()]
    at = [0, 1, 2, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66, 70]
    assert anew == [None] + [(b - a) * 60_000_000 for a, b in zip(at, at[1:], strict=False)]
