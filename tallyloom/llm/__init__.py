"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames with ``documents``-like columns, selects what it needs by name
before it adds columns of its own (so extra columns can't clash), and states
its result for nulls, empty texts, ties and repeated rows in its docstring.
"""
