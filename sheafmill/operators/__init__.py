"""Relational operators over documents, pages, layout items and batches."""
