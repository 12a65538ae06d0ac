"""Operators for preparing training corpora: one module per operator.

Nothing else in the library imports this package; it may be removed whole.
"""
