"""Readers and writers of receipt data."""
