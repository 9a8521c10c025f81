"""Readers and writers of review data."""
