"""Structured Streaming forms of boards that the application refreshes live."""
