"""Reconciliation operators: DataFrames in, DataFrame out."""
