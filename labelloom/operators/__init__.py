"""Operators of the labelled-data engine."""
