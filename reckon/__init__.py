"""Keyed table reconciliation on Spark."""
