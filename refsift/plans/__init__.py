"""From entries and sources to results: registry, stages, engine."""
