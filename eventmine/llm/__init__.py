"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; its registered queries
and SQL are in :mod:`eventmine.llm.queries`.
"""
