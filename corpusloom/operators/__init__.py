"""Operators of the corpus toolkit."""
