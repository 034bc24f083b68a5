"""Operators: evaluation, aggregation, ranking, comparison, splitting, validation."""
