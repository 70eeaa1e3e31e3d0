"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every module holds one
operator with its own interface; ``queries`` binds them to the tables.
"""
