"""Operators of a training-data pipeline: dedup, joins, search, tokenization, packing, scanning.

Nothing outside this subpackage imports it; ``queries`` holds what the driver entry registers.
"""
