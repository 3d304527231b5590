"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it. ``registry`` holds the queries.
"""
