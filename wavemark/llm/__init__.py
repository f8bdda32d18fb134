"""Operators for building training corpora of text."""
