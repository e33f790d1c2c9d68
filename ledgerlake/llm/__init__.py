"""Operators for large training-text corpora, each a Spark job over whole tables.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
