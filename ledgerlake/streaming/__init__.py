"""Incremental import of the inbox."""
