"""Lazy DataFrame operators over the long patient table."""
