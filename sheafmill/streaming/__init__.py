"""Incremental document processing."""
