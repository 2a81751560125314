"""Operators for preparing training text, independent of the pivot engine.

Each module holds one operator with its own interface; ``queries`` registers the
thin queries over the given tables. Nothing outside this package imports it.
"""
