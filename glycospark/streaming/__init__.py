"""Structured Streaming counterparts for live feeds."""
