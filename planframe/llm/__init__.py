"""Operators of a training-data pipeline over ``documents`` and ``pages`` tables.

Nothing else in the library imports this subpackage; its queries are in
``planframe.llm.queries``.
"""
