"""Operators of the analytics engine."""
