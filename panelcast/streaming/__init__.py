"""Streaming variants of the stream-safe operators."""
