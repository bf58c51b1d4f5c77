"""Structured Streaming: watched files."""
