"""Operators for building training data from text at scale.

Nothing outside this package imports it.  ``queries.QUERIES`` lists the
registered queries.
"""
