"""Structured Streaming use of the fitted operators (scoring new flow files)."""
