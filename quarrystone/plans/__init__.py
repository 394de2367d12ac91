"""Dialect parser, cardinality estimates, planner."""
