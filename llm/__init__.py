"""Operators of a training-data pipeline over document, page and embedding tables.

Nothing else in the library imports this package; it uses the library's general helpers.
"""
