"""Operators of a large-scale training-data pipeline.

Each module states one operator with its own general interface; ``queries`` holds
the thin registered queries.  Nothing else in the library imports this package.
"""
