"""Operators for large text corpora: filters, deduplication, tokenising, packing and archive formats.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries and their SQL.
"""
