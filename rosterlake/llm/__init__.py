"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Each operator module has a
general function on DataFrames; ``queries.py`` binds them to the tables under
the contracts of ``op1`` to ``op10``.
"""
