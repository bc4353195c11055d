"""Postings, statistics, matching and ranking."""
