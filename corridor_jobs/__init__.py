"""Spark jobs for transit corridor analytics."""
