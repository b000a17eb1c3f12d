"""Streams: incoming rows are scored against a fitted reference."""
