"""Ledger forensics as Spark jobs: many cases at once, keyed by case."""
