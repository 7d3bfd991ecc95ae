"""Column functions: text, identifiers, venues, authors and similarities."""
