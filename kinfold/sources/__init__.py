"""Readers, writers, schemas and work tables."""
