"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings its share of the output to its target weight; each document
draws its count by inverting the Poisson distribution at a number hashed from seed and id, is exploded by that
count, and all copies are dealt out and ordered by another hash.  Results depend on ids, sources and seed only.

Defined results: null and very long texts pass through; a null source is a source of its own; rows that share an id
(null included) share the draw, and their equal copies the place in the order, in which ties are as Spark leaves them;
an empty table gives an empty result; a source with weight 0 goes.  Rows are carried in a struct, so columns may have
any names; only :func:`mix` adds columns, and raises ValueError if there are such already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import hash_unit, let, no_clash

#: Larger means are drawn as sums of several draws of at most this mean, whose exp(-mean) is a normal double.
MAX_MEAN = 200.0
#: Sources up to this number are sent to all executors (at most some 4 kB each); more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 2_000
SALTS = 64


def source_rates(docs: DataFrame, *, source: str = "source", weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): the mean repetition of each source.

    The target weight of a source is ``weights[source]`` or, without weights, its count to the power ``alpha``; the
    output has ``epochs`` times the rows of the input in the mean.
    """
    counts = docs.select(F.col(f"`{source}`").alias("__source")).groupBy("__source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        pairs = [F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*pairs, F.lit(0.0))
    counts = counts.withColumn("__w", weight)
    totals = counts.agg(F.sum("n_docs").alias("n"), F.sum("__w").alias("w")).first()
    n, w = float(totals["n"] or 0), float(totals["w"] or 0)
    rate = F.lit(epochs * n) * F.col("__w") / F.lit(w or 1.0) / F.col("n_docs")
    return counts.select("__source", "n_docs", rate.alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as doubles differ from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    state = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), state, step, lambda s: s["all"])


def poisson_counts(docs: DataFrame, rates: DataFrame, *, id_column: str, source: str, seed: int, n_sources: int) -> DataFrame:
    """(row, own, rate, n): each row of ``docs``, its id as text, its source's rate and its draw."""
    tables = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
    tables = tables.select(F.col("__source").alias("key"), "rate", "draws", _cdf(F.col("rate") / F.col("draws")).alias("cdf"))
    id_text = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_text.alias("own"), F.col(f"`{source}`").alias("origin"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(tables), rows["origin"].eqNullSafe(tables["key"]))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)))
        tables = tables.withColumn("tsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(tables, salted["origin"].eqNullSafe(tables["key"]) & (F.col("salt") == F.col("tsalt")))

    def draw(j: Column) -> Column:
        u = hash_unit(F.lit(str(seed)), F.col("own"), j.cast("string"))
        return let(u, lambda v: F.size(F.filter(F.col("cdf"), lambda c: c <= v)).cast("bigint"))

    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0).cast("bigint"), lambda t, j: t + draw(j))
    return joined.select("row", "own", "rate", count.alias("n"))


def _mixed(docs: DataFrame, id_column: str, source: str, weights: dict | None, alpha: float, epochs: float, seed: int) -> DataFrame:
    """(row, rate, n, copy, key) of every copy, in shuffled order."""
    rates = source_rates(docs, source=source, weights=weights, alpha=alpha, epochs=epochs)
    n_sources = rates.limit(MAX_BROADCAST_SOURCES + 1).count()
    drawn = poisson_counts(docs, rates, id_column=id_column, source=source, seed=seed, n_sources=n_sources)
    copies = drawn.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "own", F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    # a hash of the copy decides its partition and its place there: a global shuffle in one exchange
    return copies.select("row", "rate", "n", "copy", key.alias("key")).repartition("key").sortWithinPartitions("key")


def mix(docs: DataFrame, *, id_column: str = "doc_id", source: str = "source", weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` plus ``__rate``, ``__count``, ``__copy`` (from 0) and ``__key``, in shuffled order."""
    no_clash(docs.columns, ["__rate", "__count", "__copy", "__key"])
    out = _mixed(docs, id_column, source, weights, alpha, epochs, seed)
    return out.select("row.*", F.col("rate").alias("__rate"), F.col("n").alias("__count"), F.col("copy").alias("__copy"), F.col("key").alias("__key"))


def replicate(docs: DataFrame, *, id_column: str = "doc_id", source: str = "source", weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The columns of ``docs``, whatever their names: each row as often as its draw says, in shuffled order."""
    return _mixed(docs, id_column, source, weights, alpha, epochs, seed).select("row.*")


def poisson_cdf(mean: float) -> list[float]:
    """The table of :func:`_cdf`, for tests."""
    p = c = math.exp(-mean)
    out = [c]
    for k in range(1, math.ceil(mean + 12 * math.sqrt(mean) + 20) + 1):
        p = p * mean / k
        c += p
        out.append(c)
    return out
