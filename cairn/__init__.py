"""Cairn: analytics over evolving collections of identified entities, on Spark DataFrames."""

__version__ = "0.1.0"
