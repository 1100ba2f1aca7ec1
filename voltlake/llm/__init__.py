"""Operators of a training-data pipeline: tokenising, decontamination, deduplication, formatting, scoring.

Nothing else in the library imports this subpackage.
"""
