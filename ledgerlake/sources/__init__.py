"""Readers: bank exports, authored configuration, logs."""
