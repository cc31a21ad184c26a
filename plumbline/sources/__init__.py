"""Readers, writers and the adapters that derive stories, predictions and sprints from the given tables."""
