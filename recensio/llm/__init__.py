"""Operators for a training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator (DataFrame in, DataFrame out) and the thin ``opN_<name>`` query that
applies it to a whole table; ``registry`` collects the queries.
"""
