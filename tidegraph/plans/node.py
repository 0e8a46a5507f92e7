"""Nodes: immutable operators bound to the outputs of other nodes, each with an identity."""

from __future__ import annotations

import base64
import dataclasses
import enum
import hashlib
import json
import math
from collections.abc import Callable, Mapping
from datetime import date, datetime, timedelta

from tidegraph.operators.base import Operator, resolve
from tidegraph.plans.types import RESERVED, ColumnSignature, FrameSignature, Tolerance


class NullPolicy(enum.Enum):
    """What a node does with missing values of an input."""

    ERROR = "error"
    PROPAGATE = "propagate"
    DROP = "drop"
    FILL = "fill"
    PASS = "pass"


@dataclasses.dataclass(frozen=True)
class Output:
    """A column of a node, to bind inputs to."""

    node: Node
    column: str


def canonical(value) -> object:
    """A value as JSON with its type written out; equal values have equal text."""
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int):
        return {"int": str(value)}
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("an identity can't hold a number that isn't finite")
        return {"float": value.hex()}
    if isinstance(value, bytes):
        return {"bytes": base64.b64encode(value).decode()}
    if isinstance(value, datetime | date):
        return {"time": value.isoformat()}
    if isinstance(value, timedelta):
        return {"us": str(round(value.total_seconds() * 1e6))}
    if isinstance(value, enum.Enum):
        return {"enum": f"{type(value).__name__}.{value.name}"}
    if isinstance(value, Mapping):
        return {"map": [[canonical(k), canonical(v)] for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))]}
    if isinstance(value, list | tuple):
        return [canonical(v) for v in value]
    if isinstance(value, set | frozenset):
        return {"set": sorted(json.dumps(canonical(v), sort_keys=True) for v in value)}
    if dataclasses.is_dataclass(value):
        own = {f.name: getattr(value, f.name) for f in dataclasses.fields(value) if f.name not in getattr(value, "EXCLUDED", ())}
        return {"type": type(value).__qualname__, "fields": canonical(own)}
    if hasattr(value, "identity"):
        return {"type": type(value).__qualname__, "identity": canonical(value.identity())}
    if callable(value):
        if "<" in value.__qualname__:
            raise ValueError("only named top-level functions have an identity")
        return {"function": f"{value.__module__}.{value.__qualname__}"}
    return {"text": str(value)}


class Node:
    """An operator, its bindings, and how it takes nulls and stale values.

    ``bindings`` maps input names to outputs (``other.output("x")`` or ``other.x``).  ``parameters`` are the
    operator's fields, or ``config`` is an operator as such.  Nodes don't change once made.
    """

    def __init__(
        self, operator: type | str, bindings: Mapping[str, Output] | None = None, parameters: Mapping | None = None, *, config: Operator | None = None, name: str | None = None, version: str | None = None, materialize: bool | None = None,
        tolerances: Mapping | None = None, null_policies: Mapping | None = None, null_fill_values: Mapping | None = None, null_handlers: Mapping[str, Callable] | None = None, null_handler_versions: Mapping[str, str] | None = None,
    ):
        if isinstance(operator, str):
            operator = resolve(operator, version or "0.1.0")
        if config is not None and parameters is not None:
            raise ValueError("give parameters or a config, not both")
        self.op: Operator = config if config is not None else operator.build(dict(parameters or {}))
        self.bindings = dict(bindings or {})
        self.tolerances = {k: Tolerance.parse(v) for k, v in (tolerances or {}).items()}
        self.null_policies = {k: NullPolicy(v) for k, v in (null_policies or {}).items()}
        self.null_fill_values = dict(null_fill_values or {})
        self.null_handlers = dict(null_handlers or {})
        self.null_handler_versions = dict(null_handler_versions or {})
        if both := set(self.null_policies) & set(self.null_handlers):
            raise ValueError(f"inputs {sorted(both)} have a null policy and a handler")
        if missing := set(self.null_handlers) - set(self.null_handler_versions):
            raise ValueError(f"null handlers of {sorted(missing)} need a version")
        self.name = name or self.op.OP.rsplit(".", 1)[-1]
        self.materialize = materialize
        self.issues: list[tuple[str, str]] = []
        self.signature = self._resolve()
        self.id = hashlib.sha256(json.dumps(self.definition(), sort_keys=True).encode()).hexdigest()
        self._frozen = True

    def __setattr__(self, key, value):
        if getattr(self, "_frozen", False):
            raise AttributeError("nodes can't be changed")
        object.__setattr__(self, key, value)

    def __getattr__(self, column: str) -> Output:
        if column.startswith("_") or "signature" not in self.__dict__:
            raise AttributeError(column)
        return self.output(column)

    def __repr__(self) -> str:
        return f"<{self.label}>"

    @property
    def label(self) -> str:
        return f"{self.name} ({self.op.OP}@{self.op.VERSION})"

    @property
    def parents(self) -> list[Node]:
        return list({b.node.id: b.node for b in self.bindings.values()}.values())

    def output(self, column: str) -> Output:
        if self.signature is not None and column != RESERVED and column not in self.signature:
            raise AttributeError(f"{self.label} has no output {column!r}")
        return Output(self, column)

    def given(self, name: str) -> ColumnSignature | None:
        bound = self.bindings.get(name)
        if bound is None or bound.node.signature is None:
            return None
        if bound.column == RESERVED:
            return ColumnSignature(RESERVED, "int64")
        return bound.node.signature[bound.column] if bound.column in bound.node.signature else None

    def _resolve(self) -> FrameSignature | None:
        """The output signature; everything wrong with the bindings goes to ``issues``."""
        names, add = self.op.inputs(), lambda code, text: self.issues.append((code, text))
        if not names and self.bindings:
            add("UNEXPECTED_BINDING", "a source has no inputs")
        if names and not self.bindings:
            add("NON_EMPTY_INPUT_WITHOUT_BINDINGS", f"inputs {names} are not bound")
        elif missing := [n for n in names if n not in self.bindings]:
            add("MISSING_BINDING", f"inputs {missing} are not bound")
        for n in self.bindings:
            if names and n not in names:
                add("UNEXPECTED_BINDING", f"there is no input {n!r}")
        for n in self.tolerances:
            if n not in self.bindings:
                add("UNEXPECTED_TOLERANCE", f"{n!r} is not bound")
        for n in {**self.null_policies, **self.null_handlers}:
            if n not in names:
                add("UNEXPECTED_NULL_HANDLER", f"there is no input {n!r}")
        for n in self.null_fill_values:
            if self.null_policies.get(n) is not NullPolicy.FILL:
                add("UNEXPECTED_NULL_FILL_VALUE", f"{n!r} is not filled")
        for n, p in self.null_policies.items():
            if p is NullPolicy.FILL and n not in self.null_fill_values:
                add("MISSING_NULL_FILL_VALUE", f"{n!r} is filled with nothing")
        given = {n: self.given(n) for n in names}
        for n, g in given.items():
            if g is None and n in self.bindings:
                add("PARENT_OUTPUT_MISSING", f"{n!r} is bound to an output that doesn't exist")
            elif g is not None and g.name != RESERVED and (why := self.op.accepts(n, g)):
                add("INPUT_TYPE_MISMATCH", why)
        axes = [p.signature.time for p in self.parents if p.signature is not None]
        for a in axes[1:]:
            if a.column != axes[0].column:
                add("TIME_COLUMN_MISMATCH", f"{a.column} and {axes[0].column}")
            if a.dtype != axes[0].dtype:
                add("TIME_DTYPE_MISMATCH", f"{a.dtype} and {axes[0].dtype}")
            if a.timezone != axes[0].timezone:
                add("TIMEZONE_MISMATCH", f"{a.timezone} and {axes[0].timezone}")
        if self.issues:
            return None
        out = self.op.outputs(given)
        return FrameSignature(out.columns, axes[0]) if axes else out

    def definition(self) -> dict:
        """What the identity is a digest of: names, materialisation and credentials are no part of it."""
        own = {k: v for k, v in self.op.params().items() if k not in self.op.EXCLUDED}
        return {
            "op": self.op.OP, "version": self.op.VERSION, "params": canonical(own),
            "bindings": {k: [b.node.id, b.column] for k, b in sorted(self.bindings.items())},
            "tolerances": {k: canonical(v) for k, v in sorted(self.tolerances.items())},
            "nulls": {k: p.value for k, p in sorted(self.null_policies.items())},
            "fills": {k: canonical(v) for k, v in sorted(self.null_fill_values.items())},
            "handlers": {k: [canonical(f), self.null_handler_versions[k]] for k, f in sorted(self.null_handlers.items())},
            "outputs": [[c.name, c.dtype, list(c.shape)] for c in self.signature.columns] if self.signature else None,
        }

    def policy(self, name: str) -> NullPolicy:
        return self.null_policies.get(name, NullPolicy.ERROR if self.op.STRICT else NullPolicy.PROPAGATE)
