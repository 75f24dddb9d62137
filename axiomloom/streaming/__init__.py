"""Assertions that arrive over time."""
