"""Operators for training-data pipelines: deduplication, filtering, extraction, tokenising.

Nothing outside this subpackage imports it. One module per operator; `queries` registers
one query for each.
"""
