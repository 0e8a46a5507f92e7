"""Walk-forward supervised models."""

from tidegraph.operators.models import estimators, store, walk  # noqa: F401
