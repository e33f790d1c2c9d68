"""Household-ledger analytics on Spark."""
