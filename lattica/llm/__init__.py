"""Operators for building training corpora; nothing else in lattica imports this."""
