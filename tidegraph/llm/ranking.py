"""Quality classifier: Bradley-Terry pairwise ranking, then a threshold at a score quantile.

Each document has a feature vector x of its whole text.  A preference pair is a good and a bad labelled document;
P(good beats bad) = sigmoid(w . (x_good - x_bad)), and w minimises the logistic loss over pairs with a small ridge.
A document's rank score is w . x.  The decision threshold is the quantile of the training scores that leaves above
it the share of good labels in training; the reported score is a sigmoid around that threshold.

The training set is bounded: at most ``max_labelled`` rows, those with the least md5 of their id (parameter), and
``pairs_per_row`` opponents for each (repeated rows count once; of ids that stand for several texts, at most four times
as many rows in all);
scoring covers every row.  Features are computed in Arrow batches from the text
alone.  Defined results: null text is the empty text and has a score; rows that share an id are scored each, equal
texts and ties alike; texts may be of any length; null labels and labels of ids that are not in the documents are passed
over; without labelled documents of both classes there is nothing to rank, and every score is 0.5; an empty documents
table gives an empty result; an id column named like an output column raises ValueError, other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash
from tidegraph.llm.rules import STOP_WORDS

_STOP = {w.encode() for w in STOP_WORDS}
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _SYMBOLS, _MARKS = b"0123456789", b"#*$%&|<>@^~=_\\{}[]", b".,;:'\"()-"


def features_of(body: bytes) -> tuple[float, ...]:
    """The feature vector of a UTF-8 text, a fixed cost for each byte."""
    n = len(body)
    words = body.split()
    k = len(words)
    of = lambda chars: n - len(body.translate(None, chars))
    upper, lower, symbols, digits, marks = of(_UPPER), of(_LOWER), of(_SYMBOLS), of(_DIGITS), of(_MARKS)
    bangs, pipes = body.count(b"!"), body.count(b"|")
    lines = [x for x in body.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    capital = sum(map(bytes.isupper, words))
    stop = sum(w in _STOP for w in words)
    k1, n1, l1 = max(k, 1), max(n, 1), max(len(lines), 1)
    return (
        min(math.log1p(k), 9.0) / 4,
        min(1.0, math.log1p(k) / 3),
        float(k < 10),
        float(k == 0),
        min((n - k) / k1 / 6, 4.0),
        symbols / n1,
        min(1.0, symbols / k1),
        bangs / n1,
        min(1.0, bangs / k1),
        min(1.0, pipes / k1),
        upper / max(upper + lower, 1),
        capital / k1,
        digits / n1,
        marks / n1,
        1 - distinct / k1,
        1 - pairs / max(k - 1, 1) if k > 1 else 0.0,
        same / k1,
        1 - len(set(lines)) / l1,
        stop / k1,
        min(k / l1 / 40, 3.0),
        float(symbols > 0.2 * k1),
        float(bangs > 0.2 * k1),
        float(capital > 0.3 * k1),
        float(same > 0.05 * k1),
        float(pairs < 0.7 * (k - 1)),
    )


@dataclass(frozen=True)
class Ranker:
    """A fitted model: rank score = weights . (x - mean) / scale; score = sigmoid((rank - threshold) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    temperature: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.rank(x) - self.threshold) / self.temperature, -500, 500)))


def unranked(width: int) -> Ranker:
    """The model of no pairs: every score is 0.5."""
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)


def fit_pairs(x: np.ndarray, y: np.ndarray, *, pairs_per_row: int = 20, ridge: float = 1e-3, steps: int = 30, seed: int = 11) -> Ranker:
    """Fit by Newton's method on the pairwise logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        raise ValueError("labels of both classes are needed")
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, pairs_per_row), rng.choice(good, len(bad) * pairs_per_row)])
    b = np.concatenate([rng.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
    w = np.zeros(z.shape[1])
    gain = lambda w: sum(-np.logaddexp(0, -((z[a[i : i + 65536]] - z[b[i : i + 65536]]) @ w)).sum() for i in range(0, len(a), 65536)) / len(a) - ridge / 2 * w @ w
    now = gain(w)
    for _ in range(steps):
        slope, bend = -ridge * w, ridge * np.eye(len(w))
        for i in range(0, len(a), 65536):
            d = z[a[i : i + 65536]] - z[b[i : i + 65536]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            slope = slope + d.T @ p / len(a)
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / len(a)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (after := gain(w + size * step)) < now and size > 1e-4:
            size /= 2
        if after <= now + 1e-10:
            break
        w, now = w + size * step, after
    rank = z @ w
    # the quantile below which lies the share of bad labels
    share = float((y == 0).mean())
    ordered = np.sort(rank)
    cut = min(len(ordered) - 1, max(1, round(share * len(ordered))))
    threshold = float((ordered[cut - 1] + ordered[cut]) / 2)
    return Ranker(mean, scale, w, threshold, 1.0)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000, **options) -> Ranker:
    """Fit on at most ``max_labelled`` labelled documents: those with the least md5 of their id."""
    order = F.md5(F.concat(F.lit("rank|"), F.col("id").cast("string")))
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(order, "y").limit(max_labelled)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def compute(batches):
        for batch in batches:
            body = batch.column(0).cast(pa.binary()).to_pylist()
            x = [features_of(b or b"") for b in body]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "y", "at"])

    # in an order by a hash of id and text: where ids repeat so often that rows are cut, both classes are cut alike
    rows = rows.select("body", "y", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("body", F.lit("")))).alias("at"))
    found = rows.mapInArrow(compute, "x array<double>, y int, at string").dropDuplicates(["at", "y"]).orderBy("at", "y", "x").limit(4 * max_labelled).toArrow()
    y, x = found.column("y").to_numpy(), np.array(found.column("x").to_pylist(), np.float64)
    if len(set(y.tolist())) < 2:
        return unranked(len(features_of(b"")))
    return fit_pairs(x, y, **options)


def score(docs: DataFrame, model: Ranker, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    no_clash([id_column], ["score", "predicted"])
    schema = T.StructType([docs.schema[id_column], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def compute(batches):
        for batch in batches:
            body = batch.column(1).cast(pa.binary()).to_pylist()
            s = model.score(np.array([features_of(b or b"") for b in body], np.float64)) if body else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(compute, schema)
