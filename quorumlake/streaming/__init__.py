"""Streaming forms of operators that keep state between events."""
