"""Spark operators over panels (date, symbol, ...): sources, features, labels, splits, signals, ledgers and statistics."""
