"""Operators of a training-data pipeline over the ``documents`` family of tables.

Self-contained: nothing else in the library imports this package. One module
per operator, ``queries.py`` registers the ``opN_*`` queries.
"""
