"""The operators as data, for documentation and tools."""

from __future__ import annotations

import json
import sys
from dataclasses import MISSING, fields
from pathlib import Path

from tidegraph.operators.base import REGISTRY


def describe(cls: type) -> dict:
    """An operator's name, version, text and parameters."""
    import inspect

    params = []
    for f in fields(cls):
        default = None if f.default is MISSING else f.default
        params.append({"name": f.name, "type": str(f.type), "required": f.default is MISSING and f.default_factory is MISSING, "default": default if isinstance(default, bool | int | float | str | type(None)) else str(default)})
    return {"op": cls.OP, "version": cls.VERSION, "kind": cls.KIND, "description": inspect.getdoc(cls) or "", "lookahead": cls.LOOKAHEAD, "whole_frame": cls.BATCH, "parameters": params}


def catalog() -> dict:
    import tidegraph.api  # noqa: F401

    return {"format": "tidegraph.catalog", "version": "0.1.0", "operations": [describe(c) for _, c in sorted(REGISTRY.items())]}


def dump_catalog(path: str | Path | None = None) -> str:
    text = json.dumps(catalog(), indent=1, sort_keys=True)
    if path:
        Path(path).write_text(text + "\n", encoding="utf-8")
    return text


if __name__ == "__main__":
    print(dump_catalog(sys.argv[1] if len(sys.argv) > 1 else None))
