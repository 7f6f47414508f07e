"""Import every module that registers queries."""

from checks import signal_queries, table_queries, trade_queries  # noqa: F401
