"""Operators for preparing large text corpora as training data.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold its registered queries.
"""
