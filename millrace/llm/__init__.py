"""Operators for large training corpora.

Each module holds one operator with its own general interface and one thin
``query`` that applies it, with production parameters, to a whole table.
Nothing else in the library imports this subpackage.
"""
