"""The public names, in one place.  Importing this registers all operators."""

from tidegraph.operators.backtest.engine import Backtest, run_groups  # noqa: F401
from tidegraph.operators.backtest.parts import (  # noqa: F401
    FixedFees, FractionalKelly, FractionalLimit, L1Feed, L2Feed, ModelPolicy, OrderModelPolicy, Policy, RiskPolicy, RiskReason, SignalPolicy, ThresholdPolicy, Venue, classify_reason, dense_side, interpolate_volumes, ladder_prices,
    list_fee_schedules, list_policies, list_risk_policies, register_fee_schedule, register_policy, register_risk_policy,
)
from tidegraph.operators.base import REGISTRY, Operator, operation  # noqa: F401
from tidegraph.operators.metrics import Mae, MaxDrawdown, Metric, MetricError, Mse, Sharpe, TotalReturn  # noqa: F401
from tidegraph.operators.models.store import ModelStore  # noqa: F401
from tidegraph.operators.models.walk import (  # noqa: F401
    CNN1D, AnyScheduler, ChronologicalSplitter, DenseMLP, EveryNTicksScheduler, FrozenScheduler, Infer, InferenceOperator, LightGBM, LinearRegression, LogisticRegression, MetricThresholdScheduler, SupervisedModel, TrainingOperator, TrainLinear, parse_scheduler, parse_splitter,
)
from tidegraph.operators.ordered import BlockPermute, EwmMean, EwmStd  # noqa: F401
from tidegraph.operators.transforms import (  # noqa: F401
    Abs, Clip, Delta, Exp, FeaturePacker, FeatureUnpacker, Lag, Lead, Log, Logit, LogRatio, LogReturn, Negate, PctChange, Power, Product, Ratio, RollingCov, RollingCovMatrix, RollingMax, RollingMean, RollingMedian, RollingMin,
    RollingPercentileRank, RollingQuantile, RollingStd, RollingSum, RollingVar, RollingZScore, Sign, Spread, Sqrt,
)
from tidegraph.plans.frames import Chunking  # noqa: F401
from tidegraph.plans.graph import ExecutionError, Executor, Graph, GraphError  # noqa: F401
from tidegraph.plans.node import Node, NullPolicy, Output  # noqa: F401
from tidegraph.plans.types import ColumnSignature, FrameSignature, TimeAxis, Tolerance  # noqa: F401
from tidegraph.sources.files import CSVSource, DatasetManifest, DatasetSource, ParquetSource, StreamingParquetSource, build_manifest, merkle_root, merkle_sha256_source, sha256_file, sha256_source  # noqa: F401
from tidegraph.sources.s3 import S3Credentials, current_s3_credentials  # noqa: F401
from tidegraph.sources.inline import DataFrameSource, OhlcvSource, PriceHistory  # noqa: F401
