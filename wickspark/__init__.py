"""Candlestick signals and rule-based trade statistics as PySpark DataFrame operators."""
