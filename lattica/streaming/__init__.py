"""Streams of overrides into an incrementally calculated table."""
