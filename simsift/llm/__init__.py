"""Operators of a training-data pipeline: one module for each operator, plus
``words`` (shared text scanning) and ``queries`` (registered queries, SQL)."""
