"""Operators for training-data pipelines (language ID, deduplication, decontamination, ...).

Nothing else in the library imports this subpackage.
"""
