"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``catalog`` holds the thin queries.
"""
