"""Streaming of the labelled-data engine."""
