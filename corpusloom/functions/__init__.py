"""Functions of the corpus toolkit."""
