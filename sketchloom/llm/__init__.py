"""Operators for preparing language-model training data, each usable on its own.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin contract queries, every other module one operator.
"""
