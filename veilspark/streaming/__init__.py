"""Operators on streams of text chunks and requests."""
