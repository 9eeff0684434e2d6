"""Operators of a training-data pipeline: packing, search, tokens, dedup, archives and filters.

Nothing else in the package imports this subpackage; deleting the folder leaves the rest working.
"""
