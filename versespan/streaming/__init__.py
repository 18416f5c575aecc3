"""Structured Streaming maintenance of the sheet table."""
