"""Plans of the corpus toolkit."""
