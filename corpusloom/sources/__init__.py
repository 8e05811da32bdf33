"""Sources of the corpus toolkit."""
