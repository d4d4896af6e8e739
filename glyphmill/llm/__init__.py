"""Operators for training-data pipelines over the ``documents`` family of tables.

Nothing outside this folder imports it.  ``registry`` lists the queries.
"""
