"""Operators of a training-data pipeline: packing, near duplicates, extraction, archives, filters and scores.

Nothing else in the library imports this subpackage.
"""
