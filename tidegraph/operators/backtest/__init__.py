"""The event-by-event trading backtest."""

from tidegraph.operators.backtest import engine  # noqa: F401
