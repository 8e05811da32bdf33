"""Streaming of the corpus toolkit."""
