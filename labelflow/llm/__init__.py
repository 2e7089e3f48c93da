"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries.py`` binds them to the given
tables as ``opN_<name>`` queries.
"""
