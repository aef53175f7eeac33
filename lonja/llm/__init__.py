"""Operators for training-data pipelines (problems tagged llm). Nothing outside this package imports it."""
