"""Streaming twins of the event and folder operators."""
