"""Readers for raw exports, run folders and stored forecasts."""
