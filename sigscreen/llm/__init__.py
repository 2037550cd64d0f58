"""Operators for text corpora: tokens, near duplicates, repeated passages, labels, search."""
