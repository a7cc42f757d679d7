"""Structured Streaming over files and chunks."""
