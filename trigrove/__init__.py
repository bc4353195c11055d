"""Typo-tolerant search over tabular data as Spark plans."""
