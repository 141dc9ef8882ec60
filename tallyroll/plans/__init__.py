"""Receipts derived from the driver tables, the query catalogue and its oracle SQL."""
