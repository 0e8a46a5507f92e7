"""What operators are, and the registry of them."""

from __future__ import annotations

import re
from dataclasses import fields, is_dataclass

from tidegraph.plans.types import ColumnSignature, FrameSignature

REGISTRY: dict[tuple[str, str], type] = {}


def operation(kind: str, version: str = "0.1.0"):
    """Register a dataclass operator under ``kind.snake_name`` and its version."""

    def register(cls):
        words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", cls.__name__)).lower()
        cls.OP, cls.VERSION, cls.KIND = f"{kind}.{words}", version, kind
        REGISTRY[cls.OP, version] = cls
        return cls

    return register


def resolve(op: str, version: str) -> type:
    known = [v for o, v in REGISTRY if o == op]
    if (op, version) in REGISTRY:
        return REGISTRY[op, version]
    raise KeyError(f"unknown operation {op!r}" if not known else f"{op!r} has version {', '.join(known)}, not {version}")


class Operator:
    """An operator: parameters (a dataclass's fields), named inputs, typed outputs, and a way to be lowered.

    KIND decides how it is run: "source" has no inputs; "metrics" gives one row; BATCH operators see the whole frame
    in order; all others are columns on their parents' timeline.
    """

    OP = VERSION = KIND = ""
    BATCH = LOOKAHEAD = False
    #: Inputs whose null policy is "error" unless said otherwise.
    STRICT = False
    #: A BATCH operator that deals rows to other times, and delta_t with them: its ``run`` gets and gives that column too.
    MOVES_ROWS = False
    #: Parameters that are no part of the operator's identity.
    EXCLUDED: tuple[str, ...] = ()

    def inputs(self) -> list[str]:
        raise NotImplementedError

    def accepts(self, name: str, given: ColumnSignature) -> str | None:
        """Why an input can't be bound to such a column; None if it can."""
        return None if given.dtype == "float64" else f"{name} must be float64, not {given.dtype}"

    def outputs(self, given: dict[str, ColumnSignature]) -> FrameSignature:
        raise NotImplementedError

    def halo(self) -> tuple[int, int] | None:
        """Rows before and after that a row's result reads; None: the row itself."""
        return None

    def trailing_rows(self) -> int | None:
        """Earlier rows that a live runner must hold; None: all of them."""
        return (self.halo() or (0, 0))[0]

    def columns(self, given: dict, kinds: dict[str, ColumnSignature], over) -> list:
        """One Column for each output, from the inputs' Columns."""
        raise NotImplementedError

    def trains(self) -> tuple[str, str] | None:
        """(store, group) of the models that the operator adds, if it does."""
        return None

    def infers(self) -> tuple[str, str] | None:
        """(store, group) whose latest model the operator looks up, if it does."""
        return None

    def params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)} if is_dataclass(self) else {}

    @classmethod
    def build(cls, params: dict):
        names = {f.name for f in fields(cls) if f.init}
        if unknown := set(params) - names:
            raise ValueError(f"{cls.OP}: unknown parameters {sorted(unknown)}")
        return cls(**params)


def positive(value: int, name: str, least: int = 1) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
