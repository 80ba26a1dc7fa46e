"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Each module has one operator with a general interface.  ``queries`` holds the thin queries
that apply the operators, with production parameters, to the whole intended table.
"""
