"""Bibliographies checked as they arrive."""
