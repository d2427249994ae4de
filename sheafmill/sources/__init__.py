"""Scans of files and sinks per document."""
