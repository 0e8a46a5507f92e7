import numpy as np
import pandas as pd
import pytest
from support import column, minute, series

from tidegraph import api as A
from tidegraph.operators.backtest.engine import Account, execute, walk
from tidegraph.operators.backtest.parts import L2Feed, Market, best_level, cost_eps
from tidegraph.operators.models import estimators as E
from tidegraph.operators.models.walk import walk_forward
from tidegraph.plans.graph import Graph
from tidegraph.plans.node import Node


def data(n=300, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    return x, (x @ [[2.0], [-1.0]]) + 0.5


def test_linear_and_ridge():
    x, y = data()
    m = E.LinearRegression().fit(x, y)
    assert m.coefficients[:, 0] == pytest.approx([2, -1]) and m.intercept[0] == pytest.approx(0.5)
    assert np.abs(E.LinearRegression(100.0).fit(x, y).coefficients).sum() < 3
    with pytest.raises(E.FitError):
        E.LinearRegression().fit(x, y * np.nan)


def test_logistic():
    x, _ = data(2000)
    p = 1 / (1 + np.exp(-(x @ [1.5, -0.5] + 0.2)))
    y = (np.random.default_rng(1).random(2000) < p).astype(float)[:, None]
    m = E.LogisticRegression().fit(x, y)
    assert m.coefficients[:, 0] == pytest.approx([1.5, -0.5], abs=0.25)
    assert np.corrcoef(m.predict(x)[:, 0], p)[0, 1] > 0.99
    with pytest.raises(E.FitError):
        E.LogisticRegression().fit(x, y + 0.5)


def test_slopes_of_networks():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(7, 3)), r.normal(size=(7, 2))
    arrays = E._init(r, [3, 4, 2])
    slopes, _ = E._dense_slopes(arrays, x, y)
    loss = lambda: ((E.Dense(tuple(zip(arrays[::2], arrays[1::2], strict=True))).predict(x) - y) ** 2).mean()
    for a, g in zip(arrays, slopes, strict=True):
        a.flat[0] += 1e-6
        up = loss()
        a.flat[0] -= 2e-6
        down = loss()
        a.flat[0] += 1e-6
        assert g.flat[0] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_trees_see_rows_of_equal_bins_once(monkeypatch):
    r = np.random.default_rng(1)
    x, seen, grow = r.integers(0, 9, (5000, 2)).astype(float), [], E.GradientBoosting._tree
    y = np.sin(x[:, :1]) * x[:, 1:] + r.normal(size=(5000, 1))
    monkeypatch.setattr(E.GradientBoosting, "_tree", lambda self, binned, *more: (seen.append(len(binned)), grow(self, binned, *more))[1])
    m = E.GradientBoosting(5, 0.5, min_data_in_leaf=1, num_leaves=81).fit(x, y)
    assert seen == [81] * 5
    # leaves of one kind each: every round halves the distance to the kind's mean
    means = np.array([y[(x == k).all(axis=1)].mean() for k in x])
    assert m.predict(x)[:, 0] == pytest.approx(means + (y.mean() - means) * 0.5**5, abs=1e-9)


def test_blocks_give_the_slopes_of_the_whole(monkeypatch):
    r = np.random.default_rng(2)
    x, y, arrays = r.normal(size=(1000, 3)), r.normal(size=(1000, 2)), E._init(r, [3, 5, 2])
    monkeypatch.setattr(E, "BLOCK", 96)
    blocks = E._blocks(x, y)
    assert len(blocks) == 11
    for a, b in zip(E._block_slopes(arrays, blocks), E._dense_slopes(arrays, x, y)[0], strict=True):
        assert a == pytest.approx(b, abs=1e-12)
    whole = E.Dense(tuple(zip(arrays[::2], arrays[1::2], strict=True))).predict(x)
    assert E._block_loss(arrays, blocks) == pytest.approx(((whole - y) ** 2).mean())


def test_convolutions_take_needed_steps_only():
    r = np.random.default_rng(3)
    k1, k2 = r.normal(size=(3, 2, 4)), r.normal(size=(2, 4, 5))
    b1, b2, head = r.normal(size=4), r.normal(size=5), (r.normal(size=(5, 1)), r.normal(size=1))
    net = E.Conv(8, ((k1, b1, 1), (k2, b2, 2)), E.Dense((head,)))
    assert net.steps() == [[3, 4, 5, 6, 7], [5, 7], [7]]
    assert E.Conv(2, ((k1, b1, 1),), E.Dense((head,))).steps() == [[0, 1], [1]]  # steps before the sequence count as zero
    x = r.normal(size=(3000, 2))
    one = lambda at, k, b, d, layer: np.maximum(sum(layer(at - (len(k) - 1 - j) * d) @ k[j] for j in range(len(k))) + b, 0)
    for row in (7, 1031, 2999):
        first = lambda at: one(at, k1, b1, 1, lambda s: x[s])
        assert net.predict(x)[row] == pytest.approx(one(row, k2, b2, 2, first) @ head[0] + head[1])


def test_each_task_has_one_share_of_a_walk(spark, sf_dir):
    from tidegraph import queries

    dealt = []
    old = A.LightGBM.estimator
    try:
        A.LightGBM.estimator = lambda self: Where()
        dealt = [r["prediction"] for r in queries.boosting(spark, sf_dir).collect() if r["prediction"] is not None]
    finally:
        A.LightGBM.estimator = old
    assert len(set(dealt)) == 2


class Where:
    """An estimator that predicts the number of the task it is in."""

    def fit(self, x, y, xv, yv, seed):
        from pyspark import TaskContext

        return Constant(float(TaskContext.get().partitionId()))


class Constant:
    def __init__(self, value):
        self.value = value

    def predict(self, x):
        return np.full((len(x), 1), self.value)


def test_networks_and_trees_learn():
    x, y = data(600)
    base = float(((y - y.mean()) ** 2).mean())
    for est, share in ((E.DenseMLP((16,), 200, 1e-2), 0.1), (E.GradientBoosting(60, 0.2), 0.2), (E.CausalConv(4, (8,), (2,), epochs=40, learning_rate=1e-2), 0.4)):
        out = est.fit(x, y, None, None, 3).predict(x)
        good = np.isfinite(out[:, 0])
        assert ((out - y)[good] ** 2).mean() < share * base, type(est).__name__
    conv = E.CausalConv(4, (8,), (2,), epochs=1).fit(x, y, None, None, 3).predict(x)
    assert np.isnan(conv[:3]).all() and np.isfinite(conv[3:]).all()


def test_early_stopping():
    x, y = data(200)
    y = y + np.random.default_rng(2).normal(size=y.shape) * 3
    m = E.GradientBoosting(200, 0.5, early_stopping_rounds=3).fit(x[:100], y[:100], x[100:], y[100:])
    assert len(m.trees) < 200


def test_schedulers_and_splitter():
    assert A.parse_scheduler({"any": [{"every": 5}, {"metric": {"name": "mse", "threshold": 1, "check_every": 3}}]}).decide(3, 100, 3, {"mse": 2}).retrain
    assert not A.FrozenScheduler().decide(0, 10, 0, None).retrain
    assert [s.stop for s in A.ChronologicalSplitter(0.2, 0.1, gap=2, purge_window=5).split(105)] == [66, 88, 100]
    with pytest.raises(E.FitError):
        A.ChronologicalSplitter(purge_window=10).split(5)
    for bad in ({"every": 0}, {"odd": 1}, {"every": 1, "frozen": True}):
        with pytest.raises(ValueError):
            A.parse_scheduler(bad)


def brute_retrains(declared, rows, errors):
    """Rows at which a walk retrains, by counting row by row; ``errors(row)`` is the error of a trained model."""
    out, since, looked, begun = [], 0, 0, 0
    every, metric = declared.get("every"), declared.get("metric")
    for row in range(rows):
        boundary = row == 0 or (every and since and since % every == 0) or (metric and looked == metric["check_every"])
        if boundary:
            segment = [errors(r) for r in range(begun, row)] if out else []
            due = row > 0 and ((every and since >= every) or (metric and segment and sum(segment) / len(segment) > metric["threshold"]))
            if due:
                out.append(row)
                since = 0
            looked, begun = 0, row
        since, looked = since + 1, looked + 1
    return out


def pair_sum(x):
    return Node(A.Spread, {"left": x, "right": Node(A.Negate, {"x": x}, {"input_column": "x", "output_column": "n"}).n}, {"left_column": "left", "right_column": "right", "output_column": "out"}).out


def test_schedulers_against_a_row_by_row_count():
    class Spy:
        def __init__(self):
            self.rows = []

        def fit(self, x, y, xv, yv, seed):
            self.rows.append(len(x) + len(xv))
            return self

        def predict(self, x):
            return np.zeros((len(x), 1))

    r = np.random.default_rng(8)
    y = r.normal(size=(2000, 1)) * np.repeat(r.choice([0.1, 3], 40), 50)[:, None]
    for every, metric in ((100, None), (2500, {"threshold": 1.0, "check_every": 50}), (300, {"threshold": 1.0, "check_every": 70}), (250, {"threshold": 1e12, "check_every": 50}), (90, {"threshold": -1.0, "check_every": 40})):
        declared = [{"every": every}] + ([{"metric": {"name": "mse", **metric}}] if metric else [])
        spy = Spy()
        walk_forward(np.zeros((2000, 1)), y, spy, A.parse_scheduler({"any": declared}), A.ChronologicalSplitter(), 0)
        assert spy.rows == brute_retrains({"every": every, "metric": metric}, 2000, lambda i: float(y[i, 0]) ** 2), (every, metric)
    with pytest.raises(ValueError):
        A.AnyScheduler(())


def test_inference_runs_after_its_trainer(spark, tmp_path):
    x = series([float(i) for i in range(40)], name="x")
    pack = lambda o, n: Node(A.FeaturePacker, {"x": o}, {"input_columns": ("x",), "output_column": n}).output(n)
    double = pair_sum(x.x)
    features, target = pack(x.x, "f"), pack(double, "t")
    where = {"store_path": str(tmp_path / "store")}
    fit = Node(A.TrainLinear, {"features": features, "target": target}, where, name="fit")
    # an inference node's id may sort before or after the trainer's: the order must not depend on it
    for k in range(4):
        infer = Node(A.Infer, {"features": features}, {**where, "group": "default", "target_width": 1}, name=f"n{k}")
        graph = Graph([infer, fit])
        order = [n.name for n in graph.nodes]
        assert order.index("fit") < order.index(f"n{k}")
        out = graph.execute(spark)[infer.id].collect()
        assert [r["prediction"][0] for r in out] == pytest.approx([2.0 * i for i in range(40)])
    other = Node(A.TrainLinear, {"features": features, "target": target}, {**where, "l2": 1.0}, name="again")
    assert [i.code for i in Graph.validate([fit, other])] == ["MULTIPLE_TRAINERS"]
    assert not Graph.validate([fit, Node(A.TrainLinear, {"features": features, "target": target}, {**where, "group": "b"})])
    pinned, frozen = A.Infer(model_id="m"), A.Infer(frozen=True)
    assert pinned.infers() is None and frozen.infers() is None and A.Infer().infers() == ("", "default")
    with pytest.raises(ValueError):
        A.Infer(model_id="")


def test_kelly_and_reasons():
    from types import SimpleNamespace

    from tidegraph.operators.backtest import parts

    p, a = np.array([0.6, 0.5, 0.2, 0.9, 0.7]), np.array([0.5, 0.5, 0.4, 1.0, 0.1])
    row = SimpleNamespace(signal=p, ask=a, equity=1000.0, cash=1000.0)
    got = parts.FractionalKelly(0.5).limit(row, np.zeros(5))
    # the stake that makes the expected logarithm of wealth largest, by search
    for i in range(5):
        f = np.linspace(0, 0.9999, 200_001)
        growth = p[i] * np.log1p(f * (1 - a[i]) / a[i]) + (1 - p[i]) * np.log1p(-f) if a[i] < 1 else -f
        assert got[i] == pytest.approx(0.5 * 1000 * f[np.argmax(growth)] / a[i], abs=0.5 / a[i])
    reasons = [parts.classify_reason(x, y) for x, y in (([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 1.0]), ([1.0, 2.0], [0.0, 0.0]), ([0.0], [0.0]))]
    assert reasons == [parts.RiskReason.NO_CHANGE, parts.RiskReason.CLAMPED, parts.RiskReason.ZEROED, parts.RiskReason.NO_CHANGE]


def test_walk_forward_sees_only_the_past():
    x, y = data()
    out = walk_forward(x, y, E.LinearRegression(), A.EveryNTicksScheduler(100), A.ChronologicalSplitter(), 0)
    assert np.isnan(out[:100]).all() and out[100:] == pytest.approx(y[100:])
    later = y.copy()
    later[200:] += 50
    again = walk_forward(x, later, E.LinearRegression(), A.EveryNTicksScheduler(100), A.ChronologicalSplitter(), 0)
    assert again[:200] == pytest.approx(out[:200], nan_ok=True)
    assert np.isnan(walk_forward(x, y, E.LinearRegression(), A.FrozenScheduler(), A.ChronologicalSplitter(), 0)).all()


def test_model_operator_and_store(spark, tmp_path):
    x = series([float(i) for i in range(60)], name="x")
    pack = lambda o, n: Node(A.FeaturePacker, {"x": o}, {"input_columns": ("x",), "output_column": n}).output(n)
    features, target = pack(x.x, "f"), pack(Node(A.Clip, {"x": x.x}, {"input_column": "x", "output_column": "y", "upper": 1e9}).y, "t")
    out = column(spark, Node(A.LinearRegression, {"features": features, "target": target}, {"scheduler": {"every": 20}}).prediction)
    assert [v[0] for v in out[20:]] == pytest.approx(list(range(20, 60)))
    store = str(tmp_path / "store")
    assert column(spark, Node(A.TrainLinear, {"features": features, "target": target}, {"store_path": store}).output("delta_t")) == []
    got = column(spark, Node(A.Infer, {"features": features}, {"store_path": store}).prediction)
    assert [v[0] for v in got] == pytest.approx(list(range(60)))
    models = A.ModelStore(spark, store)
    one = models.save_run("g", E.GradientBoosting(2).fit(*data(100)), minute(5))
    assert one == models.save_run("g", models.load_model(one), minute(5)) and models.select_run("g", minute(9))["model_id"] == one
    with pytest.raises(KeyError):
        models.select_run("g", minute(4))


# the backtest


def frame(bid, ask, signal, **more):
    n = len(bid)
    cols = {"bid": bid, "ask": ask, "signal": signal, **more}
    return pd.DataFrame({"timestamp": [minute(i) for i in range(n)], **{k: [np.atleast_1d(np.array(v, float)) for v in c] for k, c in cols.items()}})


def run(cols, **params):
    op = A.Backtest(feed={"kind": "l1", "venue": {"name": "v", "universe": ["a"]}}, initial_cash=params.pop("cash", 100.0), **params)
    return op.simulate(cols, "timestamp")


def test_market_orders_and_marks():
    out = run(frame([10, 11, 12], [10.5, 11.5, 12.5], [2, 0, -3]))
    assert out["cash"].tolist() == [79, 79, 115] and out["equity"].tolist() == [99, 101, 103]
    assert [b[0] for b in out["balance"]] == [2, 2, -1] and [p[0] for p in out["fill_price"]] == [10.5, 0, 12]


def test_buys_are_gated_and_sales_are_not():
    out = run(frame([10, 10], [60, 60], [3, -3]))
    assert [o[0] for o in out["order"]] == [0, -3] and out["unfilled"][0][0] == 3


def test_ruin_sells_all_and_stops():
    rise = run(frame([10, 30, 50], [10, 30, 50], [-20, 0, 5]), cash=10.0)
    assert rise["balance"][1][0] == 0 and rise["order"][1][0] == 20 and rise["order"][2][0] == 0 and rise["cash"][2] == rise["cash"][1] == 10 + 200 - 600


def test_limits_rest_and_pay_maker():
    out = run(frame([10, 9, 9], [11, 9.5, 9.5], [1, 0, 0], limit=[9.6, np.nan, np.nan]), limit_price_column="limit", fee_schedule={"kind": "fixed", "taker_rate": 0.01, "maker_rate": 0.001})
    assert out["open_orders"][0].tolist() == [1, 0] and out["balance"][1][0] == 1
    assert out["cash"][1] == pytest.approx(100 - 9.6 - 0.0096) and out["fees"][2] == pytest.approx(0.0096)
    gone = run(frame([10, 9], [11, 9.5], [1, 0], limit=[9.6, np.nan], cancel=[0, 1]), limit_price_column="limit", cancel_column="cancel")
    assert gone["balance"][1][0] == 0 and gone["open_orders"][1].tolist() == [0, 0]
    taken = run(frame([10], [11], [1], limit=[12.0]), limit_price_column="limit", slippage_spread_fraction=0.5)
    assert taken["fill_price"][0][0] == 11.5


def test_ladders():
    price, volume = np.array([10.0, 11.0, 12.0]), np.array([1.0, 2.0, 5.0])
    assert walk(price, volume, 2.0, float("nan"), True) == (2.0, pytest.approx(10.5))
    assert walk(price, volume, 9.0, 11.0, True) == (3.0, pytest.approx(32 / 3))
    assert best_level(np.array([[[5.0, 4.0]]]), np.array([[[0.0, 1.0]]]))[0, 0] == 4
    assert A.ladder_prices(0.5, 0.0, 4) == pytest.approx([0.5, 1 / 3, 1 / 6, 0])
    assert A.interpolate_volumes(np.array([0.0, 1.5, 9.0]), np.array([1.0, 2.0]), np.array([4.0, 6.0])).tolist() == [0, 5, 0]
    acct = Account(100.0, 1, A.FixedFees(), 0.0)
    m = Market(np.array([[9.0]]), np.array([[10.0]]), np.array([[[9.0, 8.0]]]), np.array([[[1.0, 1.0]]]), np.array([[[10.0, 11.0]]]), np.array([[[1.0, 1.0]]]))
    done, _, left, _ = execute(acct, m, 0, np.array([3.0]), np.array([[10.5]]), None)
    assert done[0] == 1 and left[0] == 2 and acct.resting[0, 0] == 2 and acct.cash == 90
    with pytest.raises(ValueError):
        L2Feed(A.Venue("v", ("a",)), depth_levels=2).check(Market(m.bid, m.ask, m.bid_price[:, :, ::-1], m.bid_volume, m.ask_price, m.ask_volume))


def test_risk_and_policies():
    cap = run(frame([10], [10], [50]), risk_policy={"kind": "fractional_limit", "fraction": 0.5})
    assert cap["order"][0][0] == pytest.approx(5) and cap["proposed_order"][0][0] == 50
    kelly = run(frame([0.4], [0.5], [0.75]), risk_policy={"kind": "fractional_kelly", "custom_fraction": 0.5})
    assert kelly["order"][0][0] == pytest.approx(0.5 * 0.5 * 100 / 0.5)
    out = run(frame([10] * 3, [10] * 3, [0.6, 0.5, -0.7]), policy={"kind": "threshold", "threshold": 0.5})
    assert [o[0] for o in out["order"]] == [1, 0, -1]
    assert A.classify_reason([1, 2], [1, 2]) == A.RiskReason.NO_CHANGE and A.classify_reason([1], [0]) == A.RiskReason.ZEROED and A.classify_reason([2], [1]) == A.RiskReason.CLAMPED
    for bad in ({"kind": "odd"}, {"kind": "fractional_limit", "fraction": 2.0}):
        with pytest.raises(ValueError):
            run(frame([1], [1], [0]), risk_policy=bad)
    assert "threshold" in A.list_policies() and cost_eps(0) == 1e-9


def test_model_policies_against_a_walk_row_by_row():
    n, r = 80, np.random.default_rng(4)
    x = r.normal(size=n)
    y = 2 * x + np.where(np.arange(n) > 50, 3.0, 0.0)
    cols = frame([10.0] * n, [10.0] * n, x, target=y)

    class Signs(A.OrderModelPolicy):
        def interpret(self, prediction, row):
            return np.sign(prediction)

    for every, history in ((20, 1000), (7, 15)):
        how = {"estimator": E.LinearRegression(1e-6), "scheduler": {"every": every}, "splitter": {"validation_size": 0.25}, "history_rows": history}
        want = np.zeros(n)
        for i in range(every, n):
            cut = i - i % every
            lo = max(0, cut - history)
            upto = cut - int(np.ceil(0.25 * (cut - lo)))
            want[i] = E.LinearRegression(1e-6).fit(x[lo:upto, None], y[lo:upto, None]).predict(x[i : i + 1, None])[0, 0]
        out = run(cols, policy=A.OrderModelPolicy(**how), target_column="target", cash=1e6)
        assert [o[0] for o in out["proposed_order"]] == pytest.approx(want)
        signs = run(cols, policy=Signs(**how), target_column="target", cash=1e6)
        assert [o[0] for o in signs["proposed_order"]] == np.sign(want).tolist()
    never = run(cols, policy=A.OrderModelPolicy(E.LinearRegression(), {"frozen": True}), target_column="target")
    assert not any(o[0] for o in never["order"])
    # an error of a single row beyond the threshold refits at the next look
    state = (jumpy := A.OrderModelPolicy(E.LinearRegression(1e-6), {"any": [{"every": 40}, {"metric": {"threshold": 1.0, "check_every": 10}}]})).start()
    from tidegraph.operators.backtest.parts import Row

    fits = []
    for i in range(n):
        jumpy.decide(state, Row(i, np.ones(1), np.ones(1), x[i : i + 1], 1.0, np.zeros(1), y[i : i + 1], n))
        fits.append(state.fits)
    assert fits[39] == 0 and fits[50] == 1 and fits[60] == 2
    with pytest.raises(ValueError):
        run(cols, policy=A.OrderModelPolicy(E.LinearRegression()))
    with pytest.raises(ValueError):
        A.OrderModelPolicy(E.LinearRegression(), history_rows=0)
    with pytest.raises(NotImplementedError):
        A.ModelPolicy(E.LinearRegression()).interpret(np.zeros(1), None)


def test_validation_of_quotes():
    for bid, ask, signal in (([-1], [1], [0]), ([2], [1], [0]), ([1], [np.nan], [0]), ([1], [1], [np.nan])):
        with pytest.raises(ValueError):
            run(frame(bid, ask, signal))


def test_runs_side_by_side(spark):
    op = A.Backtest(feed={"kind": "l1", "venue": {"name": "v", "universe": ["a"]}}, initial_cash=100.0)
    rows = [(k, minute(i), [10.0 + i], [10.0 + i], [float(k)]) for k in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "run long, timestamp timestamp_ntz, bid array<double>, ask array<double>, signal array<double>")
    out = {(r["run"], r["timestamp"]): r["equity"] for r in A.run_groups(op, df, "run").collect()}
    assert len(out) == 12 and out[2, minute(2)] == pytest.approx(100 + 2 * 2 + 2 * 1)


def test_cash_of_many_trades_is_exact():
    """0.1 paid 60,000 times from 1e8: a plain running sum is off by far more than its last digit."""
    n = 60_000
    at = pd.date_range("2026-01-01", periods=n, freq="s")
    one = [np.array([1.0])] * n
    out = run(pd.DataFrame({"timestamp": at, "bid": [np.array([0.1])] * n, "ask": [np.array([0.1])] * n, "signal": one}), cash=1e8)
    assert out["cash"].tolist() == [1e8 - k / 10 for k in range(1, n + 1)] and set(out["equity"]) == {1e8}


def test_backtest_goes_batch_by_batch():
    """A run in pieces is the run of the whole, also beyond ruin; a time that comes again in the next piece is refused."""
    from tidegraph.operators.backtest.engine import Simulation

    op = A.Backtest(feed={"kind": "l1", "venue": {"name": "v", "universe": ["a"]}}, initial_cash=10.0)
    g = frame([10, 30, 50, 60, 70], [10, 30, 50, 60, 70], [-20, 0, 5, 1, 1])
    parts, one = [], Simulation(op, "timestamp", len(g))
    for at in range(0, len(g), 2):
        parts.append(one.step(g.iloc[at : at + 2].reset_index(drop=True)))
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), op.simulate(g, "timestamp"))
    with pytest.raises(ValueError):
        one.step(g.iloc[-1:])


def test_growing_fits_are_the_fits_of_the_whole_history():
    r = np.random.default_rng(3)
    x = np.round(r.normal(500, 20, (600, 2)), -1)
    y = x @ [[2.0], [-1.0]] + r.normal(size=(600, 1))
    z = (r.random((600, 1)) < 0.4).astype(float)
    for estimator, target in ((E.LinearRegression(), y), (E.LinearRegression(5.0), y), (E.LogisticRegression(1e-6), z)):
        growing = estimator.growing(x, target)
        for to in (1, 50, 51, 400, 600, 30):
            if to > 1 or isinstance(estimator, E.LinearRegression):
                a, b = growing.fit(to), estimator.fit(x[:to], target[:to])
                np.testing.assert_allclose(a.predict(x), b.predict(x), rtol=1e-8)
    same = np.ones((9, 1))  # a constant feature: solved from its rows
    np.testing.assert_allclose(E.LinearRegression().growing(same, same * 3).fit(9).predict(same), 3 * same)


def test_dealt_walks_are_the_walk_in_one_task(spark):
    x, y = data(400)
    rows = spark.createDataFrame([(minute(i), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "timestamp timestamp_ntz, features array<double>, target array<double>")
    for scheduler in ({"every": 60}, {"any": [{"every": 60}, {"metric": {"threshold": 1e12, "check_every": 25}}]}, {"any": [{"every": 60}, {"metric": {"threshold": 0.0, "check_every": 25}}]}):
        op = A.CNN1D(sequence_length=4, epochs=2, scheduler=scheduler)
        wanted = walk_forward(x, y, op.estimator(), op.scheduler, op.splitter, 0, 3)
        out = op.run(rows, "timestamp", {}, "timestamp timestamp_ntz, prediction array<double>")
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        np.testing.assert_allclose(np.array([r["prediction"] for r in out.orderBy("timestamp").collect()], float), wanted)


def test_rows_without_orders_are_passed_at_once(monkeypatch):
    """The results are those of the walk row by row, resting orders and ruin too."""
    from tidegraph.operators.backtest import engine

    r, n = np.random.default_rng(5), 4000
    bid = np.round(50 + np.cumsum(r.normal(size=(n, 1)), axis=0).clip(-49, None), 2)
    g = pd.DataFrame({"timestamp": [minute(k) for k in range(n)], "bid": list(bid), "ask": list(bid + 0.01), "signal": list((r.random((n, 1)) < 0.03) * r.choice([-1.0, 1.0], (n, 1))), "limit": list(bid - 0.5)})
    calls, old = [], engine.execute
    monkeypatch.setattr(engine, "execute", lambda *a: (calls.append(1), old(*a))[1])
    for cash in (1000.0, 60.0):
        for more in ({"policy": {"kind": "threshold", "threshold": 0.5}, "risk_policy": {"kind": "fractional_limit", "fraction": 0.5}, "limit_price_column": "limit"}, {}):
            op = A.Backtest(feed={"kind": "l1", "venue": {"name": "v", "universe": ["a"]}}, initial_cash=cash, **more)
            calls.clear()
            fast = op.simulate(g, "timestamp")
            few = len(calls)
            with monkeypatch.context() as m:
                m.setattr(engine.Simulation, "_still", lambda self, market, r, moving, n: r)
                calls.clear()
                slow = op.simulate(g, "timestamp")
            assert few < len(calls) / 4 or len(calls) < 400
            for c in slow:
                assert np.array_equal(np.stack(slow[c].to_numpy()), np.stack(fast[c].to_numpy())), c
