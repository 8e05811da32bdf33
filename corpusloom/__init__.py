"""Corpus preparation, retrieval and grounding as Spark DataFrame operators."""
