"""Equi-joins, prefix joins, loaders and generators, declared with the DataFrame API."""
