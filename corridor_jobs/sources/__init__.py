"""Readers, writers, and adapters from other tables."""
