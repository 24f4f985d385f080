"""Reconciliation and training-data jobs on Spark."""
