"""Ingest of many drifting source files into one corpus, and the table sinks."""
