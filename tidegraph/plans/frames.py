"""Timelines: what nodes are lowered onto.

A timeline is one DataFrame with one row per timestamp, or, if its source keeps repeated times, with one row per
timestamp and place in source order: its time column is then that pair.  Every node that keeps its parents' rows adds its columns to
the timeline of its parents, so chains and diamonds need no join at all: the whole graph stays one plan, in which
Catalyst merges windows of one order into one sort and drops columns nobody reads.  Only nodes whose parents live on
different timelines are aligned, by one aggregation (the union of the timelines) and one window (carrying each
parent's last row as a struct, so that nulls inside a matched row stay null).

A timeline has no key, so a plain ordered window runs in one task.  Above ``chunk_above`` rows a timeline is cut into
chunks of consecutive rows instead: rows are numbered by a range partitioning in time, and each window runs inside
chunks that hold a halo of the neighbouring rows that its frame can reach.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.plans.types import Tolerance

TIME, INDEX, CHUNK = "__t", "__i", "__c"
_serial = itertools.count()


@dataclass(frozen=True)
class Chunking:
    """Timelines of more than ``above`` rows are cut into chunks of ``rows`` rows."""

    above: int = 5_000_000
    rows: int = 500_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidegraph-')}"


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; in local mode, where one machine is all, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moment(df: DataFrame) -> Column:
    """The time of a timeline's rows, without their place in source order."""
    return F.col(f"{TIME}.t") if repeats(df) else F.col(TIME)


def repeats(df: DataFrame) -> bool:
    return isinstance(df.schema[TIME].dataType, T.StructType)


class Timeline:
    """One row per timestamp (see the module's text for repeated ones); grows columns as nodes are lowered onto it."""

    def __init__(self, df: DataFrame, chunking: Chunking, indexed: bool = False, size: Callable[[], int] | None = None, root: int | None = None):
        """size: gives an upper bound of the rows, more cheaply than counting ``df`` would.

        root: names the timeline that the rows were taken from; rows of one root are the same rows.
        """
        self.df, self.chunking, self.indexed = df, chunking, indexed
        self.size = lru_cache(maxsize=1)(size or df.count)
        self.counted = indexed
        self.serial = next(_serial)
        self.root = self.serial if root is None else root

    def name(self) -> str:
        return f"c{next(_serial)}"

    def index(self) -> None:
        """Number the rows in time, once, if there are enough of them to be cut into chunks."""
        if self.counted:
            return
        self.counted = True
        if self.size() <= self.chunking.above:
            return
        self.df = numbered(self.df)
        self.indexed = True

    def add(self, make, halo: tuple[int, int] | None = None) -> list[str]:
        """Add columns; ``make(over)`` gives them, where over(back, ahead) is the frame of so many rows.

        halo: how many rows before and after a row its columns read; None: the row itself only.
        """
        if halo is None:
            columns = {self.name(): c for c in make(None)}
            self.df = self.df.withColumns(columns)
            return list(columns)
        self.index()
        if not self.indexed:
            over = lambda back=None, ahead=0: Window.orderBy(TIME) if back is None else Window.orderBy(TIME).rowsBetween(-back, ahead)
            columns = {self.name(): c for c in make(over)}
            self.df = self.df.withColumns(columns)
            return list(columns)
        back, ahead = halo
        rows = max(self.chunking.rows, *halo)  # a chunk's halo reaches no further than the chunk beside it
        size, own = F.lit(rows), F.col(INDEX) % rows
        home = F.floor(F.col(INDEX) / size)
        places = F.array_compact(F.array(home, F.when(own >= size - back, home + 1), F.when(own < ahead, home - 1)))
        dealt = self.df.withColumn(CHUNK, F.explode(places))
        base = Window.partitionBy(CHUNK).orderBy(INDEX)
        over = lambda back=None, ahead=0: base if back is None else base.rowsBetween(-back, ahead)
        columns = {self.name(): c for c in make(over)}
        self.df = dealt.withColumns(columns).filter(F.col(CHUNK) == home).drop(CHUNK)
        return list(columns)

    def filtered(self, condition: Column) -> Timeline:
        df = self.df.filter(condition)
        return Timeline(df.drop(INDEX) if self.indexed else df, self.chunking, size=self.size, root=self.root)

    def last(self) -> Timeline:
        """Of rows of one time the last in source order."""
        if not repeats(self.df):
            return self
        names = [c for c in self.df.columns if c not in (TIME, INDEX)]
        whole = F.struct(*names) if names else F.lit(1)
        df = self.df.groupBy(F.col(f"{TIME}.t").alias("__u")).agg(F.max_by(whole, F.col(f"{TIME}.s")).alias("__row"))
        return Timeline(df.select(F.col("__u").alias(TIME), *[F.col(f"__row.{n}").alias(n) for n in names]), self.chunking, size=self.size)

    def placed(self, df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """``df``, of this timeline's rows, for a step that takes one row a time, and what gives the step's result its times.

        Repeated times are replaced by the rows' numbers.
        """
        if not repeats(df):
            return df, lambda out: out
        rows = numbered(df)
        times = rows.select(F.col(INDEX).alias("__n"), F.col(TIME).alias("__u"))

        def back(out: DataFrame) -> DataFrame:
            names = [c for c in out.columns if c != TIME]
            return out.join(times, F.col(TIME) == F.col("__n")).select(F.col("__u").alias(TIME), *names)

        return rows.withColumn(TIME, F.col(INDEX)).drop(INDEX), back


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with INDEX: the row's number in time.  One shuffle by time ranges; only partition sizes reach the driver."""
    dealt = df.drop(INDEX).repartitionByRange(TIME).sortWithinPartitions(TIME)
    dealt = staged(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = {r["__p"]: r["n"] for r in dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __start long")
    return dealt.join(F.broadcast(table), "__p").withColumn(INDEX, F.col("__start") + F.col("__k")).drop("__p", "__k", "__start")


@dataclass
class Frame:
    """The columns of a node: its names to the timeline's."""

    line: Timeline
    columns: dict[str, str]

    def column(self, name: str) -> Column:
        return F.col(self.columns[name])


def source_frame(df: DataFrame, time: str, names: list[str], chunking: Chunking, order: str | None = None, unique: bool = False, keep: bool = False) -> Frame:
    """A source's rows as a timeline: rows without a time go, of rows of one time the last in source order stays, or all if ``keep``."""
    columns = {n: f"c{next(_serial)}" for n in names}
    picked = df.filter(F.col(f"`{time}`").isNotNull()).select(F.col(f"`{time}`").alias(TIME), *[F.col(f"`{n}`").alias(c) for n, c in columns.items()], *([F.col(order).alias("__seq")] if order else []))
    if not unique:
        if order is None:
            picked = picked.withColumn("__seq", F.monotonically_increasing_id())
        if keep:
            picked = picked.withColumn(TIME, F.struct(F.col(TIME).alias("t"), F.col("__seq").alias("s"))).drop("__seq")
        else:
            whole = F.struct(*columns.values()) if columns else F.lit(1)
            picked = picked.groupBy(TIME).agg(F.max_by(whole, "__seq").alias("__row")).select(TIME, *[F.col(f"__row.{c}").alias(c) for c in columns.values()])
    else:
        picked = picked.drop("__seq")
    # before times are made unique: Parquet footers know it without reading rows
    return Frame(Timeline(picked, chunking, size=df.count), columns)


def within(now: Column, then: Column, tolerance: Tolerance) -> Column:
    """Is ``then`` at most ``tolerance`` before ``now``?  The bound itself counts."""
    if tolerance.units is not None:
        return now - then <= F.lit(tolerance.units)
    gap = F.make_dt_interval(secs=F.lit(tolerance.micros) / F.lit(1_000_000).cast("decimal(18,6)"))
    limit = then + F.make_ym_interval(F.lit(0), F.lit(tolerance.months)) if tolerance.months else then
    return now <= limit + gap


def align(wanted: list[tuple[Frame, str, Tolerance | None]], chunking: Chunking) -> Frame:
    """One frame with a column for each wanted (frame, column, tolerance), named by its position.

    Parents of one timeline stay as they are: each row matches itself, at distance zero.  Otherwise the result has
    the union of all parents' times, and each column its parent's last row at or before, if not older than its tolerance.
    Repeated times are kept between parents that have their rows from one source; else the last row of a time counts.
    """
    lines = list({f.line.serial: f.line for f, _, _ in wanted}.values())
    if len(lines) == 1:
        return Frame(lines[0], {str(i): f.columns[c] for i, (f, c, _) in enumerate(wanted)})
    if one := len({x.root for x in lines}) == 1:
        root = lines[0].root
    else:
        last, root = {x.serial: x.last() for x in lines}, None
        wanted = [(Frame(last[f.line.serial], f.columns), c, tolerance) for f, c, tolerance in wanted]
        lines = list(last.values())
    inner = ".t" if one and repeats(lines[0].df) else ""
    parts, cells = [], {}
    for k, line in enumerate(lines):
        used = sorted({f.columns[c] for f, c, _ in wanted if f.line is line})
        parts.append(line.df.select(TIME, F.struct(F.col(TIME).alias("t"), *used).alias(f"p{k}")))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    union = joined.groupBy(TIME).agg(*[F.first(f"p{k}", ignorenulls=True).alias(f"p{k}") for k in range(len(lines))])
    line = Timeline(union, chunking, size=lambda: sum(x.size() for x in lines), root=root)
    line.index()
    carried = {f"m{k}": f"p{k}" for k in range(len(lines))}
    if line.indexed:
        line.df = carry_forward(line.df, carried, chunking.rows)
    else:
        w = Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
        line.df = line.df.withColumns({m: F.last(p, ignorenulls=True).over(w) for m, p in carried.items()})
    columns = {}
    for i, (f, c, tolerance) in enumerate(wanted):
        k = next(n for n, x in enumerate(lines) if x is f.line)
        key = (k, f.columns[c], tolerance)
        if key not in cells:
            value = F.col(f"m{k}.{f.columns[c]}")
            cells[key] = line.name(), value if tolerance is None else F.when(within(F.col(f"{TIME}{inner}"), F.col(f"m{k}.t{inner}"), tolerance), value)
        columns[str(i)] = cells[key][0]
    line.df = line.df.select(TIME, *([INDEX] if line.indexed else []), *[c.alias(n) for n, c in cells.values()])
    return Frame(line, columns)


def carry_forward(df: DataFrame, carried: dict[str, str], rows: int) -> DataFrame:
    """Last non-null value so far of each column, over numbered rows: inside chunks, plus what earlier chunks end with."""
    home = F.floor(F.col(INDEX) / F.lit(rows))
    own = staged(df.withColumn(CHUNK, home))
    ends = own.groupBy(CHUNK).agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col(INDEX))).alias(p) for p in carried.values()])
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    ends = ends.select(CHUNK, *[F.last(p, ignorenulls=True).over(before).alias(f"e_{p}") for p in carried.values()])
    w = Window.partitionBy(CHUNK).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(ends, CHUNK).withColumns({m: F.coalesce(F.last(p, ignorenulls=True).over(w), F.col(f"e_{p}")) for m, p in carried.items()})
    return out.drop(CHUNK, *[f"e_{p}" for p in carried.values()])


def any_null(x: Column, kind: T.DataType) -> Column:
    """Is a value missing?  Of an array: it, or any element."""
    return x.isNull() | F.exists(x, lambda e: e.isNull()) if isinstance(kind, T.ArrayType) else x.isNull()


def fill_null(x: Column, kind: T.DataType, width: int, value) -> Column:
    if isinstance(kind, T.ArrayType):
        v = F.lit(value).cast(kind.elementType)
        return F.transform(F.coalesce(x, F.array_repeat(v, width)), lambda e: F.coalesce(e, v))
    return F.coalesce(x, F.lit(value).cast(kind))


def delta_t(line: Timeline) -> str:
    """The time since the row before: microseconds, or units of a numeric axis."""
    now = moment(line.df)
    numeric = isinstance(line.df.select(now).schema[0].dataType, T.NumericType)

    def make(over):
        prior = F.lag(now).over(over())
        return [now - prior if numeric else F.timestamp_diff("MICROSECOND", prior, now)]

    return line.add(make, (1, 0))[0]
