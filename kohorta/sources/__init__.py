"""Readers, writers, code lists and stage tables."""
