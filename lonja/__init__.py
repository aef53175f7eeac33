"""Spark-first engine for vehicle-market data: sources, text keys, joins, aggregates and table-level operators."""

__version__ = "0.1.0"
