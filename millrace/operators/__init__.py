"""Joins, prefix joins, partitioning, aggregates, orders, set operations and the result checker."""
