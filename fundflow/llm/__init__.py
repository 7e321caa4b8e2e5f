"""Operators for large-scale training-data preparation.

Ten operators, one module each, with their registered queries in ``queries.py``.
Nothing else in the library imports this subpackage.
"""
