"""Structured Streaming roll-ups of issue activity."""
