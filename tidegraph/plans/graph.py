"""Graphs: validation of a whole DAG, its identity, and its execution as Spark plans."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.plans.frames import INDEX, TIME, Chunking, Frame, Timeline, align, any_null, delta_t, fill_null, moment, repeats, source_frame, staged
from tidegraph.plans.node import Node, NullPolicy, Output
from tidegraph.plans.storage import Store
from tidegraph.plans.types import DTYPES, RESERVED
from tidegraph.sources.s3 import Provider, location, s3_scope, scan_options


@dataclass(frozen=True, order=True)
class Issue:
    node: str
    code: str
    text: str


class GraphError(ValueError):
    """A graph that is not valid; ``issues`` says all that is wrong."""

    def __init__(self, issues: list[Issue]):
        self.issues = issues
        super().__init__("\n".join(f"{i.node}: {i.code}: {i.text}" for i in issues))


class ExecutionError(RuntimeError):
    """A failure at a node."""


class Graph:
    """The nodes that lead to one or more terminals."""

    def __init__(self, nodes: Node | Iterable[Node], *, check: bool = True):
        given = [nodes] if isinstance(nodes, Node) else list(nodes)
        members = {n.id: n for n in given}
        bound = {p.id for n in given for p in n.parents}
        self.terminals = [n for n in members.values() if n.id not in bound]
        self.nodes, self.issues = self._order(members, explicit=len(given) > len(self.terminals))
        if check and self.issues:
            raise GraphError(self.issues)
        self.id = hashlib.sha256(json.dumps([sorted(n.id for n in self.nodes), sorted(n.id for n in self.terminals)]).encode()).hexdigest()

    def _order(self, members: dict[str, Node], explicit: bool) -> tuple[list[Node], list[Issue]]:
        issues, order, state = [], [], {}
        if not self.terminals:
            issues.append(Issue("graph", "NO_TERMINALS", "no node is left over as a result"))

        trainers, every, todo = {}, dict(members), list(members.values())
        while todo:
            for p in todo.pop().parents:
                if p.id not in every:
                    every[p.id] = p
                    todo.append(p)
        for n in sorted(every.values(), key=lambda n: n.id):
            if (model := n.op.trains()) is not None:
                if model in trainers:
                    issues.append(Issue(n.label, "MULTIPLE_TRAINERS", f"{trainers[model].label} trains group {model[1]!r} already"))
                trainers.setdefault(model, n)

        # live inference comes after the trainer of its group, whose model it is to find
        def before(n: Node) -> list[Node]:
            trainer = trainers.get(n.op.infers())
            return sorted([*n.parents, *([trainer] if trainer is not None else [])], key=lambda p: p.id)

        def visit(root: Node):
            stack = [(root, iter(before(root)))]
            state[root.id] = 1
            while stack:
                node, parents = stack[-1]
                for p in parents:
                    if state.get(p.id) == 1:
                        issues.append(Issue(node.label, "CYCLE", f"leads back to {p.label}"))
                    elif p.id not in state:
                        state[p.id] = 1
                        stack.append((p, iter(before(p))))
                        break
                else:
                    state[node.id] = 2
                    order.append(node)
                    stack.pop()

        for t in sorted(self.terminals, key=lambda n: n.id):
            if t.id not in state:
                visit(t)
        for n in members.values():
            if n.id not in state:
                issues.append(Issue(n.label, "UNREACHABLE_NODE", "leads to no result"))
        ahead: dict[str, bool] = {}
        for n in order:
            issues += [Issue(n.label, code, text) for code, text in n.issues]
            if explicit:
                issues += [Issue(n.label, "PARENT_OUTSIDE_GRAPH", f"{p.label} is not a member") for p in n.parents if p.id not in members]
            tainted = {k for k, b in n.bindings.items() if ahead.get(b.node.id)}
            allowed = getattr(n.op, "AHEAD_INPUTS", None)
            if allowed is not None:
                issues += [Issue(n.label, "LOOKAHEAD_INTO_FEATURES", f"{k} is made of later rows") for k in sorted(tainted - set(allowed))]
            ahead[n.id] = n.op.LOOKAHEAD or bool(tainted - set(allowed or ()))
            if n.op.BATCH and n.materialize is False:
                issues.append(Issue(n.label, "REQUIRED_MATERIALIZATION_DISABLED", "the operator sees whole frames"))
        return order, sorted(issues)

    def verify(self) -> None:
        if self.issues:
            raise GraphError(self.issues)

    @classmethod
    def validate(cls, nodes) -> list[Issue]:
        """Everything wrong with a graph, without running it."""
        return cls(nodes, check=False).issues

    def describe(self) -> dict:
        """The graph as JSON data."""
        node = lambda n: {
            "id": n.id, "name": n.name, "op": n.op.OP, "version": n.op.VERSION, "inputs": {k: f"{b.node.name}.{b.column}" for k, b in n.bindings.items()},
            "outputs": [{"name": c.name, "dtype": c.dtype, "shape": list(c.shape)} for c in (n.signature.columns if n.signature else ())],
            "materialize": bool(n.materialize or n.op.BATCH), "reason": "operator" if n.op.BATCH else "declared" if n.materialize else None, "trailing_rows": n.op.trailing_rows(),
        }
        return {"id": self.id, "terminals": [n.id for n in self.terminals], "nodes": [node(n) for n in self.nodes]}

    def execute(self, spark: SparkSession | None = None, executor: Executor | None = None, on_progress: Callable | None = None):
        """The terminal's DataFrame, in time order; with several terminals, a dict by node id."""
        executor = executor or Executor(spark or SparkSession.getActiveSession())
        out = executor.run(self, on_progress)
        return out[self.terminals[0].id] if len(self.terminals) == 1 else out


@dataclass
class Executor:
    """Lowers graphs and, where asked to, keeps nodes' results in a content-addressed cache.

    ``cache_dir`` (or TIDEGRAPH_CACHE_DIR) holds ``ab/cd/ef/rest-of-id/`` with Parquet shards and a manifest written
    last.  Sources are never cached; nodes with ``materialize`` are written, all others are read if they are there.
    """

    spark: SparkSession
    cache_dir: str | None = field(default_factory=lambda: os.environ.get("TIDEGRAPH_CACHE_DIR"))
    chunking: Chunking = field(default_factory=Chunking)
    no_cache: bool = False
    shard_rows: int = 5_000_000
    #: Credentials for S3, or a function that gives them; asked once for each execution.
    s3: Provider = field(default=None, repr=False)

    def run(self, graph: Graph, on_progress: Callable | None = None) -> dict[str, DataFrame]:
        frames = self.frames(graph, on_progress)
        return {t.id: self.result(t, frames[t.id]) for t in graph.terminals}

    def table(self, outputs: dict[str, Output], on_progress: Callable | None = None) -> DataFrame:
        """Several outputs side by side, on the union of their times: one plan for a whole strategy."""
        nodes = list({o.node.id: o.node for o in outputs.values()}.values())
        members, todo = {}, list(nodes)
        while todo:
            n = todo.pop()
            if n.id not in members:
                members[n.id] = n
                todo += n.parents
        graph = Graph(list(members.values()))
        frames = self.frames(graph, on_progress, keep={n.id for n in nodes})
        wanted = []
        for o in outputs.values():
            frame = frames[o.node.id]
            if o.column == RESERVED and RESERVED not in frame.columns:
                frame.columns[RESERVED] = delta_t(frame.line)
            wanted.append((frame, o.column, None))
        aligned = align(wanted, self.chunking)
        time_column = nodes[0].signature.time.column
        return aligned.line.df.select(moment(aligned.line.df).alias(time_column), *[aligned.column(str(i)).alias(n) for i, n in enumerate(outputs)])

    def frames(self, graph: Graph, on_progress: Callable | None = None, keep: frozenset | set = frozenset()) -> dict[str, Frame]:
        """Every needed node, lowered."""
        graph.verify()
        with s3_scope(self.s3):
            return self._frames(graph, on_progress, keep)

    def _frames(self, graph: Graph, on_progress: Callable | None, keep) -> dict[str, Frame]:
        frames: dict[str, Frame] = {}
        needed = self._needed(graph, keep)
        order = [n for n in graph.nodes if n.id in needed]
        for k, node in enumerate(order):
            try:
                hit = needed[node.id]
                frames[node.id] = self._read(node) if hit else self.lower(node, frames)
                # a cached table has times only, so rows that repeat them are not kept
                if node.materialize and not hit and node.op.inputs() and self.cache_dir and not self.no_cache and not repeats(frames[node.id].line.df):
                    frames[node.id] = self._write(node, frames[node.id])
            except ExecutionError:
                raise
            except Exception as e:
                raise ExecutionError(f"Execution failed at node '{node.name}' ({node.op.OP}@{node.op.VERSION}): {e}") from e
            if on_progress:
                on_progress(node, k + 1, len(order))
        return frames

    def result(self, node: Node, frame: Frame) -> DataFrame:
        names = [c.name for c in node.signature.columns]
        df = frame.line.df
        return df.orderBy(TIME).select(moment(df).alias(node.signature.time.column), *[frame.column(n).alias(n) for n in names])

    def lower(self, node: Node, frames: dict[str, Frame]) -> Frame:
        op = node.op
        if not op.inputs():
            df, order = op.read(self.spark)
            return source_frame(df, node.signature.time.column, [c.name for c in node.signature.columns], self.chunking, order, keep=getattr(op, "repeats", "last") == "all")
        names = op.inputs()
        wanted = []
        for n in names:
            b = node.bindings[n]
            frame = frames[b.node.id]
            if b.column == RESERVED and RESERVED not in frame.columns:
                frame.columns[RESERVED] = delta_t(frame.line)
            wanted.append((frame, b.column, node.tolerances.get(n)))
        aligned = align(wanted, self.chunking)
        line, columns = aligned.line, {n: aligned.columns[str(i)] for i, n in enumerate(names)}
        kinds = {n: node.given(n) for n in names}
        line, columns = self._nulls(node, line, columns, kinds)
        outputs = [c.name for c in node.signature.columns]
        if op.BATCH:
            return self._batch(node, line, columns, kinds, self._carried(wanted))
        if op.KIND == "metrics":
            df = op.reduce(line.df.select(TIME, *[F.col(c).alias(n) for n, c in columns.items()]), TIME)
            return Frame(Timeline(df.select(moment(df).alias(TIME), *outputs), self.chunking), {n: n for n in outputs})
        given = {n: F.col(c) for n, c in columns.items()}
        made = line.add(lambda over: op.columns(given, kinds, over), op.halo())
        out = dict(zip(outputs, made, strict=True))
        if carried := self._carried(wanted):
            out[RESERVED] = carried
        return Frame(line, out)

    @staticmethod
    def _carried(wanted) -> str | None:
        """The delta_t column that a single parent hands on; where several meet, it is made anew from the union of times."""
        found = {(f.line.serial, f.columns.get(RESERVED)) for f, _, _ in wanted}
        return found.pop()[1] if len(found) == 1 else None

    def _nulls(self, node: Node, line: Timeline, columns: dict, kinds: dict):
        """DROP and FILL in the order of inputs, then ERROR and handlers over what is left."""
        columns, late = dict(columns), []
        for n, kind in kinds.items():
            policy, x = node.policy(n), F.col(columns[n])
            if n in node.null_handlers:
                late.append(n)
            elif policy is NullPolicy.DROP:
                line = line.filtered(~any_null(x, kind.spark))
            elif policy is NullPolicy.FILL:
                columns[n] = line.add(lambda over, x=x, kind=kind, v=node.null_fill_values[n]: [fill_null(x, kind.spark, kind.width, v)])[0]
            elif policy is NullPolicy.ERROR:
                late.append(n)
        checked = [n for n in late if n not in node.null_handlers]
        if checked:
            counts = line.df.agg(*[F.count(F.when(any_null(F.col(columns[n]), kinds[n].spark), 1)).alias(n) for n in checked]).first()
            if bad := [f"{n} has {counts[n]}" for n in checked if counts[n]]:
                raise ValueError(f"missing values are an error: {', '.join(bad)}")
        for n in late:
            if n in node.null_handlers:
                line, columns = self._handle(line, columns, n, node.null_handlers[n], kinds[n])
        return line, columns

    def _handle(self, line: Timeline, columns: dict, name: str, handler, kind):
        """A handler is a function of the whole ordered series: one task by its nature."""
        (df, back), target = line.placed(line.df.drop(INDEX)), line.name()
        schema = T.StructType([*df.schema.fields, T.StructField(target, kind.spark)])
        own = columns[name]

        def apply(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(TIME, kind="stable").reset_index(drop=True)
            frame[target] = handler(frame[own])
            return frame

        out = Timeline(back(df.groupBy(F.lit("all")).applyInPandas(apply, schema)), self.chunking, root=line.root)
        return out, {**columns, name: target}

    def _batch(self, node: Node, line: Timeline, columns: dict, kinds: dict, carried: str | None) -> Frame:
        outputs = node.signature.columns
        made = {c.name: c.name for c in outputs}
        if node.op.MOVES_ROWS:  # the time since the row before goes with its row
            columns = {**columns, RESERVED: carried or delta_t(line)}
            made[RESERVED] = RESERVED
        df, back = line.placed(line.df.select(TIME, *[F.col(c).alias(n) for n, c in columns.items()]))
        schema = T.StructType([T.StructField(TIME, df.schema[TIME].dataType), *[T.StructField(c.name, c.spark) for c in outputs]])
        if node.op.MOVES_ROWS:
            schema = schema.add(df.schema[RESERVED])
        # whole-frame results are computed once, however many nodes read them, and survive lost executors
        out = staged(back(node.op.run(df, TIME, kinds, schema)))
        return Frame(Timeline(out, self.chunking, size=line.size, root=line.root), made)

    # the cache

    def _path(self, node: Node) -> str:
        i = node.id
        return f"{i[:2]}/{i[2:4]}/{i[4:6]}/{i[6:]}"

    def _hit(self, node: Node) -> bool:
        if self.no_cache or not self.cache_dir or not node.op.inputs():
            return False
        store = Store(self.spark, self.cache_dir)
        try:
            manifest = json.loads(store.read(f"{self._path(node)}/manifest.json"))
            return bool(manifest.get("success")) and bool(store.files(f"{self._path(node)}/data", ".parquet"))
        except Exception:  # a missing or broken entry is no hit
            return False

    def _needed(self, graph: Graph, keep) -> dict[str, bool]:
        """Nodes to run, from the terminals (and those to keep) back to cached ones; True: read from the cache."""
        out: dict[str, bool] = {}
        todo = [*graph.terminals, *[n for n in graph.nodes if n.id in keep]]
        while todo:
            n = todo.pop()
            if n.id not in out:
                out[n.id] = self._hit(n)
                if not out[n.id]:
                    todo += n.parents
        return out

    def _read(self, node: Node) -> Frame:
        df = self.spark.read.options(**scan_options()).parquet(f"{location(self.cache_dir).rstrip('/')}/{self._path(node)}/data")
        names = [c.name for c in node.signature.columns]
        return source_frame(df, node.signature.time.column, names, self.chunking, unique=True)

    def _write(self, node: Node, frame: Frame) -> Frame:
        path, store = self._path(node), Store(self.spark, self.cache_dir)
        df = self.result(node, frame)
        try:
            df.write.mode("overwrite").options(**scan_options()).option("maxRecordsPerFile", self.shard_rows).parquet(f"{location(self.cache_dir).rstrip('/')}/{path}/data")
            files = store.files(f"{path}/data", ".parquet")
            read = self._read(node)
            manifest = {
                "node_id": node.id, "success": True, "row_count": read.line.df.count(), "column_count": len(df.columns), "columns": df.columns, "schema": json.loads(df.schema.json()),
                "byte_size": sum(n for _, n in files), "shard_count": len(files), "created_at": time.time(),
            }
            store.write(f"{path}/manifest.json", json.dumps(manifest, indent=1).encode())
            return read
        except Exception as e:  # the result is still there; only keeping it failed
            import warnings

            warnings.warn(f"{node.label} was not cached: {e}", stacklevel=2)
            return frame


def dtype_of(kind: T.DataType) -> str | None:
    """The schema language's name of a Spark type."""
    return next((n for n, t in DTYPES.items() if t == kind), None)
