"""Relational operators on entries, records, observations and results."""
