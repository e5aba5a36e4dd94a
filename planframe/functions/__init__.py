"""Predicates, aggregates, parsing and text rendering, all as built-in column expressions."""
