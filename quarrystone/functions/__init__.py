"""Predicates and arithmetic as Columns."""
