"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator module
has a general interface; ``queries`` holds the thin registered queries.
"""
